"""The numbered queries and their SQL."""

from __future__ import annotations

from lodestone.llm import merkle, warc
from lodestone.llm.bpe import op9_bpe
from lodestone.llm.language import op10_language
from lodestone.llm.licences import op6_licences
from lodestone.llm.lz import op1_lz
from lodestone.llm.multi_index import op8_multi_index
from lodestone.llm.packing import op7_packing
from lodestone.llm.pii import op5_pii
from lodestone.llm.runs import op12_runs
from lodestone.llm.simhash import op4_simhash
from lodestone.llm.toxicity import op2_toxicity
from lodestone.llm.two_fit import op11_two_fit

QUERIES = {
    "op1_lz": op1_lz,
    "op2_toxicity": op2_toxicity,
    "op3_warc": warc.op3_warc,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_licences": op6_licences,
    "op7_packing": op7_packing,
    "op8_multi_index": op8_multi_index,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
    "op11_two_fit": op11_two_fit,
    "op12_runs": op12_runs,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES: dict[str, str] = {"op3_warc": warc.ORACLE, "op13_merkle": merkle.ORACLE}

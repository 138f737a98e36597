"""The numbered queries themselves, on a small folder, against brute force or the contract's own relations."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import lz
from lodestone.llm.queries import ORACLES, QUERIES
from tests.llm.test_functions import brute_fingerprint, components, invented


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(30)
    d = str(tmp_path_factory.mktemp("small"))
    texts = [(k, invented(rng, rng.choice([1, 6, 80]), ["gruzzle"] * 3 if k % 4 == 0 else ())) for k in range(90)]
    texts += [(90, texts[5][1]), (91, texts[5][1] + " end"), (92, None), (93, ""), (94, "x" * 40_000)]
    spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}", "y" * 1_200 if k % 5 == 0 else f"<p>{k}</p>") for k in range(30)], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    vectors = np.random.default_rng(31).normal(size=(200, 8))
    spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, texts, vectors


def rows(spark, folder, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, folder[0]).collect()}


def test_op1(spark, folder):
    got, order = rows(spark, folder, "op1_lz"), sorted(folder[1], reverse=True)
    assert len(got) == len(order)
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), lz.fingerprint(t), lz.fingerprint(edited))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"], r["near_next"]) == (lz.likeness(lz.fingerprint(t), lz.fingerprint(edited)), lz.likeness(lz.fingerprint(t), lz.fingerprint(nxt)))


def test_op2(spark, folder):
    got = rows(spark, folder, "op2_toxicity")
    assert len(got) == len(folder[1])
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    assert got[90]["score"] == got[5]["score"] and got[92]["score"] == got[93]["score"] < 0.5


def test_op3(spark, folder):
    got = rows(spark, folder, "op3_warc", "page_id")
    assert len(got) == 30 and set(ORACLES) == {"op3_warc", "op13_merkle"}
    for i, r in got.items():
        payload = ("y" * 1_200 if i % 5 == 0 else f"<p>{i}</p>").encode()
        again = i % 5 == 0 and i != 25
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", 25 if again else None)


def test_op4(spark, folder):
    got, texts = rows(spark, folder, "op4_simhash"), folder[1]
    fps = [brute_fingerprint(t or "") for _, t in texts]
    label = components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    assert {i: (f"{f:016x}", texts[c][0]) for (i, _), f, c in zip(texts, fps, label)} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}


def test_op7(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = QUERIES["op7_packing"](spark, folder[0]).toPandas()
    for i, t in folder[1]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = pieces[pieces["doc_id"] == i].sort_values("start")
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own["start"], own["length"], own["ids_crc32"]))
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096


def test_op8(spark, folder):
    got = QUERIES["op8_multi_index"](spark, folder[0]).toPandas()
    u = folder[2] / np.linalg.norm(folder[2], axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 200, 50) for i in sorted((k for k in range(200) if k != q), key=lambda k: -(u[k] @ u[q]))[:5]}
    assert len(got) == 20 and len({*zip(got["query_id"], got["vec_id"])} & want) >= 18
    assert all(abs(s - u[a] @ u[b]) < 1e-12 for a, b, s in zip(got["query_id"], got["vec_id"], got["score"]))


def test_op9(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, folder, "op9_bpe")
    for i, t in folder[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

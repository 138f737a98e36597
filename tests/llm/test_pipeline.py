"""The pipeline's stages, one by one, on planted cases."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_functions import invented

BAD = ["gruzzle", "skavort", "blimpox"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """240 labelled texts, a third toxic, then copies, near copies, private data, and texts without letters."""
    rng = random.Random(12)
    texts = [invented(rng, 120, rng.choices(BAD, k=6)) if k % 3 == 0 else invented(rng, 120) for k in range(240)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(300 + k, texts[1]) for k in range(5)] + [(310 + k, " ".join(["other", *texts[2].split()[1:]])) for k in range(2)]
    rows += [(320, texts[4] + "\nmail rosa.9@mail.example.com card 4041894974608795"), (330, "123 456"), (331, ""), (332, None), (340, invented(rng, 120, BAD * 2))]
    d = str(tmp_path_factory.mktemp("data"))
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "pseudonyms", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {k for k in range(0, 240, 3)} | {340}
    clean = set(before) - toxic
    assert len(ids["toxicity"] & toxic) <= 0.1 * len(toxic) and len(clean - ids["toxicity"]) <= 0.05 * len(clean)
    assert ids["toxicity"] - ids["language"] == {330, 331, 332} & ids["toxicity"]
    gone = ids["language"] - ids["near_duplicates"]
    assert gone == ({300, 301, 302, 303, 304, 310, 311, 320} & ids["language"]) and ids["pseudonyms"] == ids["near_duplicates"] == ids["packing"]
    after = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert all(after[i] == before[i] for i in after if "@" not in before[i])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = docs.toPandas()
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}


def test_foreign_and_random_texts_go(spark):
    """Two languages are learnt; a text of neither goes, whatever its words, and both languages' own stay."""
    rng = random.Random(13)
    syllables = {"aa": ["ta", "ro", "mi", "ne", "su", "ka", "lo", "vi"], "bb": ["gry", "sten", "orv", "lunk", "eff", "dwi", "psa", "umb"], "xx": ["zhe", "qi", "xou", "yang", "jia", "hww", "cik", "fzo"]}

    def said(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))

    rows = [(k, said(lang, rng.choice([8, 30, 120, 400])), lang) for k, lang in enumerate(["aa", "bb"] * 150)]
    foreign = [(1000 + k, said("xx", rng.choice([30, 120, 400])), None) for k in range(40)]
    noise = [(2000 + k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(80)), None) for k in range(40)]
    rows += [*foreign, *noise, (3000, "日本語の文章です。" * 20, None), (3001, "12 34", "aa"), (3002, None, "aa"), (3003, "taro", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = corpus_pipeline.language(spark, docs, "")
    kept = [r["doc_id"] for r in got.collect()]
    assert got.columns == docs.columns and len(kept) == len(set(kept))
    assert not [i for i in kept if 1000 <= i < 3003] and 3003 in kept
    assert len([i for i in kept if i < 1000]) >= 297


def test_private_data_goes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 320")
    new = corpus_pipeline.pseudonyms(spark, docs, folder).first()
    assert "rosa.9" not in new["text"] and "4041894974608795" not in new["text"] and new["n_chars"] == len(new["text"])


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_run_equals_the_stages(spark, folder):
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.select("doc_id", "start").distinct().count() == pieces.count() > 0

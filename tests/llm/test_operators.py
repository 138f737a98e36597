"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import json
import random
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, language, licences, lz, multi_index, near_duplicates, packing, pii, simhash, toxicity, vocabulary, warc
from lodestone.llm.components import connected_components
from tests.llm.test_functions import brute_fingerprint, components, invented

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id string, bucket int, fp string, key string"


def docs_of(spark, rows):
    """Rows of (doc_id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else "de", "s", 1, "x", "y", 3, "z", "k") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    out = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 40, 200])))) for k in range(60)]
    out += [(60, out[7][1]), (61, out[7][1]), (62, out[59][1] + " z"), (63, None), (64, ""), (65, " \n "), (None, "a b"), (66, "long " * 30_000), (66, "long " * 30_000)]
    return out


def edges():
    return [[], [(None, None)], [(1, None), (1, None)], [(5, "one")]]


def test_fingerprints_with_next(spark, rows):
    got = lz.spliced_with_next(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    # Rows of one id: by the hash of the whole text, as a signed number.
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz.fingerprint(t), lz.fingerprint(edited), lz.likeness(lz.fingerprint(t), lz.fingerprint(nxt))))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"])) for r in got)


@pytest.mark.parametrize("few", edges())
def test_fingerprints_of_few_rows(spark, few):
    assert lz.spliced_with_next(docs_of(spark, few)).count() == len(few)


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (5, None), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {k: 100 for k in range(101, 140)} | {201: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_classes(spark, rows):
    got = simhash.near_duplicate_classes(docs_of(spark, rows)).collect()
    fps = [brute_fingerprint(t or "") for _, t in rows]
    label = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    least = {c: min((i for (i, _), own in zip(rows, label) if own == c and i is not None), default=None) for c in label}
    want = [(i, f, least[c]) for (i, _), f, c in zip(rows, fps, label)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"])) for r in got)


def test_hot_simhash_keys_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 30, 3)) for _ in range(300)})
    monkeypatch.setattr(simhash, "GROUP", 40)
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    label = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    assert [got.get(f, f) for f in fps] == [fps[c] for c in label]


def test_survivors_are_one_of_each_class(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(30)]
    near = [" ".join(["new", *t.split()[1:]]) for t in texts[:10]]
    table = docs_of(spark, [*enumerate(texts), *((100 + k, t) for k, t in enumerate(near)), (200, texts[0]), (3, texts[3]), (None, texts[1]), (300, None), (301, "")])
    got = near_duplicates.near_duplicate_survivors(table)
    assert got.columns == table.columns
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").select("doc_id").collect()) == [*range(30), 300] and got.where("doc_id is null").count() == 1
    assert near_duplicates.near_duplicate_survivors(docs_of(spark, [])).count() == 0


def test_survivors_are_those_of_exact_similarity(spark, monkeypatch):
    """Pairs on both sides of 0.8, lines repeated in different texts, and a crowd of near copies, against brute force."""
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(120):
        base = rng.choices(words, k=rng.choice([12, 60, 150, 400]))
        texts.append(" ".join(base))
        n = len(base) - 4
        for share in rng.sample([0.74, 0.78, 0.79, 0.8, 0.81, 0.82, 0.86], 2):
            texts.append(" ".join(base[: round(n * 2 * share / (1 + share)) + 4] + rng.choices(words, k=n - round(n * 2 * share / (1 + share)))))
    line = " ".join(rng.choices(words, k=12))
    texts += [" ".join([*rng.choices(words, k=100), *[line] * 30]) for _ in range(40)]
    crowd = rng.choices(words, k=100)
    texts += [" ".join([*crowd[:k], "new", *crowd[k + 1 :]]) for k in range(60)]
    monkeypatch.setattr(near_duplicates, "GROUP", 24)
    monkeypatch.setattr(near_duplicates, "MEMBERS", 24)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert len(pairs) > 100
    want = sorted({*components(len(texts), pairs)})
    got = near_duplicates.near_duplicate_survivors(docs_of(spark, enumerate(texts)))
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == want


def test_toxicity_and_language_pass_rows_through(spark, rows):
    table = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    scored = toxicity.fit_toxicity(table, labels).score(table)
    assert scored.count() == len(rows) and scored.where("score between 0 and 1").count() == len(rows) and set(scored.columns) == set(table.columns)
    found = language.fit_languages(table).predict(table)
    assert found.count() == len(rows) and found.where("(text is null or trim(text) = '') and lang_pred <> 'und'").count() == 0
    empty = docs_of(spark, [])
    assert toxicity.fit_toxicity(empty, labels.limit(0)).score(empty).count() == language.fit_languages(empty).predict(empty).count() == 0


def test_every_language_can_be_predicted_and_giant_texts_come_last(spark):
    """More languages than any bound on their number would allow, and one text longer than all that a language may learn from."""
    rng = random.Random(17)
    rows = []
    for k in range(600):
        letters = [chr(0x4E00 + 7 * k + j) for j in range(7)]
        rows.append((k * 4 + 1, " ".join("".join(rng.choices(letters, k=4)) for _ in range(12)), f"l{k:03d}"))
    rows += [(9_001, "qzq " * 4_000, "l000")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_languages(docs, max_chars=4_000, fold=None)
    assert len(model.langs) == 600
    assert [r["lang_pred"] for r in model.predict(docs.where("doc_id < 9000")).orderBy("doc_id").collect()] == [f"l{k:03d}" for k in range(600)]
    few = [(k, invented(rng, 60, ["gruzzle"] * 5 if k % 2 else ()), k % 2) for k in range(80)] + [(900, "gruzzle " * 9_000, 1)]
    table = spark.createDataFrame([x[:2] for x in few], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in few] + [(2, 1), (5, 1)], "doc_id bigint, toxic int")
    scores = toxicity.fit_toxicity(table, labels, max_chars=60_000).score_texts([few[41][1], few[40][1]])
    assert scores[0] > 0.5 > scores[1]


def test_predictions_of_the_query(spark, tmp_path, rows):
    """op10_language itself: what the plain function gives for each text."""
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op10_language(spark, str(tmp_path)).collect()
    model = language.fit_languages(docs_of(spark, rows))
    want = [(i, zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else None, *(x[0] for x in model.predict_texts([t]))) for i, t in rows]
    assert sorted(str((a, b, c, round(d, 5))) for a, b, c, d in want) == sorted(str((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 5))) for r in got)


def test_held_out_rows_are_not_learnt_from(spark, rows):
    table = docs_of(spark, rows)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    changed = table.withColumn("text", F.when(fold == 2, "øøø ååå").otherwise(F.col("text"))).withColumn("lang", F.when(fold == 2, "xx").otherwise(F.col("lang")))
    a, b = language.fit_languages(table), language.fit_languages(changed)
    assert a.langs == b.langs and np.allclose(a.prototypes, b.prototypes)


def test_pseudonyms_column(spark):
    table = docs_of(spark, [(1, "mail a.b9@x.example.org and 10.20.30.40"), (2, None), (3, ""), (4, "again a.b9@x.example.org"), (4, "again a.b9@x.example.org")])
    got = {r["doc_id"]: r for r in pii.pseudonymise(table, b"k").collect()}
    new = got[1]["text"].split()[1]
    assert new != "a.b9@x.example.org" and got[4]["text"] == f"again {new}" and got[2]["text"] is None and got[3]["text"] == ""
    assert got[1]["pii_found"]["email"] == got[1]["pii_found"]["ip"] == 1
    assert pii.pseudonymise(docs_of(spark, []), b"k").count() == 0
    clash = table.withColumn("pseudonymised", F.lit(1)).withColumn("PII_found", F.lit(2))
    done = pii.pseudonymise(clash, b"k", found=None)
    assert done.columns == clash.columns and done.first()["PII_found"] == 2 and done.first()["pseudonymised"] == 1


def test_the_key_is_the_sessions_own(spark):
    spark.conf.unset(pii.KEY_SETTING)
    drawn = pii.session_key(spark)
    assert drawn == pii.session_key(spark) and len(spark.conf.get(pii.KEY_SETTING)) == 64
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) != drawn
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == pii.session_key(spark) != drawn
    spark.conf.unset(pii.KEY_SETTING)


def test_query_replaces_every_planted_value(spark, tmp_path):
    """op5_pii itself, on a folder: what it returns is what the plain function gives for each text."""
    texts = [(1, "card 4041894974608795 token: abc123def456"), (2, "nothing"), (3, None), (4, "x" * 50_000 + " 1999-12-31")]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op5_pii(spark, str(tmp_path)).collect()}
    f = pii.Feistel(pii.session_key(spark))
    for i, t in texts:
        new, found = pii.pseudonymised(t, f)
        assert got[i]["text"] == new and {k: got[i][f"n_{k}"] for k in pii.KINDS} == found


def test_licence_column(spark):
    table = docs_of(spark, [(1, "x\nReleased under the MIT License."), (2, None), (3, ""), *((k, "tara lomi nera " * 5) for k in range(4, 20))])
    got = {r["doc_id"]: [x["class"] for x in r["licences"]] for r in licences.fit_licences(table).scan_column(table).collect()}
    assert got[1] == ["mit"] and all(v == [] for k, v in got.items() if k != 1)
    empty = table.limit(0)
    assert licences.fit_licences(empty).scan_column(empty).count() == 0


def test_packing(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs_of(spark, rows), path).toPandas()
    want = {}
    for i, t in rows:
        want.setdefault(-1 if i is None else i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for i, own in got.fillna({"doc_id": -1}).groupby("doc_id"):
        ids, copies = want[i][0], len(want[i])
        assert own["length"].sum() == copies * len(ids) and set(own["doc_tokens"]) == {len(ids)}
        pieces = own[["start", "length", "ids_crc32"]].value_counts()
        assert (pieces == copies).all()
        at = 0
        for s, n, crc in sorted(pieces.index):
            assert s == at and zlib.crc32(ids[s : s + n].tobytes()) == crc
            at += n
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 2
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_bpe_columns(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    table = docs_of(spark, [*rows, (70, "a<|endoftext|>b"), (71, "x" * 9_000 + "<|endoftext|>" + "y z " * 3_000)])
    got = bpe.encode_texts(table, path, leaf_chars=2_000).withColumn("back", bpe.decoded("ids", path)).collect()
    want = sorted((str(i), t or "", np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in [*rows, (70, "a<|endoftext|>b"), (71, "x" * 9_000 + "<|endoftext|>" + "y z " * 3_000)])
    assert sorted((str(r["doc_id"]), r["text"], bytes(r["ids"])) for r in got) == want
    assert all(r["back"] == r["text"] for r in got)
    assert bpe.encode_texts(docs_of(spark, []), path).count() == 0


def test_many_added_tokens_take_time_in_proportion(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "ab<|endoftext|>" * 16_000
    began = time.time()
    got = bpe.encode_texts(docs_of(spark, [(1, text)]), path).first()
    assert time.time() - began < 30 and bytes(got["ids"]) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_vocabularies_out_of_merge_order_are_refused(tmp_path):
    spec = {"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, "merges": ["a b", "b c"]}}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        vocabulary.ranks(str(tmp_path / "v.json"))


def test_fingerprints_of_hot_ids(spark):
    """Half of the rows without an id and a third under one id are dealt out, and each still meets the next in order."""
    rng = random.Random(20)
    rows = [(None, "".join(rng.choices("ab ", k=30))) for _ in range(150)] + [(7, "".join(rng.choices("ab ", k=30))) for _ in range(100)] + [(k, "xyz" * k) for k in range(20, 60)] + [(None, "same")] * 30
    test_fingerprints_with_next(spark, rows)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[500:] = x[0]  # a third of a cell are copies
    data = [(k, [float(v) for v in r], 1, "x") for k, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 15), (None, [1.0] * 16), (1004, [None] * 16), (1005, [float("inf")] * 16)]
    table = spark.createDataFrame(data + [(i, v, 1, "x") for i, v in odd], "vec_id bigint, embedding array<double>, rank int, score string")
    queries = table.where("vec_id % 50 = 0 or vec_id is null")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = multi_index.nearest(table, queries, share=1.0).orderBy("query_id", "rank").collect()
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(600), key=lambda k: (-round(s[k], 12), k))[:5]
        own = [r for r in got if r["query_id"] == q]
        assert [r["vec_id"] for r in own] == best and [r["rank"] for r in own] == [1, 2, 3, 4, 5] and np.allclose([r["score"] for r in own], s[best])
    approx = multi_index.nearest(table, queries).collect()
    same = {(r["query_id"], r["vec_id"]) for r in got} & {(r["query_id"], r["vec_id"]) for r in approx}
    assert len(same) >= 0.9 * len(got)
    # Vectors in clusters need a small part of the rows.
    centres = rng.normal(size=(40, 16))
    crowd = np.concatenate([c + 0.05 * rng.normal(size=(50, 16)) for c in centres])
    u = multi_index.unit(crowd)
    index = multi_index.MultiIndex(multi_index.kmeans(u[:, :8], 16), multi_index.kmeans(u[:, 8:], 16))
    assert multi_index.measured_share(index, u, 5, 0.95) < 0.1 < multi_index.measured_share(index, multi_index.unit(rng.normal(size=(2000, 16))), 5, 0.95)
    clustered = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(crowd)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in multi_index.nearest(clustered, clustered.where("vec_id % 50 = 0")).collect()}
    near = u @ u.T
    np.fill_diagonal(near, -9)
    want = {(q, int(i)) for q in range(0, 2000, 50) for i in np.argsort(-near[q])[:5]}
    assert len(got & want) >= 0.9 * len(want)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in multi_index.nearest(few, few).orderBy("query_id").collect()] == [(0, 50), (50, 0)]
    assert multi_index.nearest(few.limit(0), few.limit(0)).count() == 0


def test_archives_against_sql(spark):
    big = "y" * 1_500
    pages = [(k, f"http://h{k % 3}.example.com/{k}", f"<p>{k}</p>" * (k * 20)) for k in range(30)]
    pages += [(40, "http://hot.example.com/", big), (41, "http://hot.example.com/", big), (39, None, big), (42, "", "small"), (43, "x", "small"), (44, "http://a.b", None)]
    table = spark.createDataFrame([(*p, 1, "k", "f") for p in pages], "page_id bigint, url string, html string, offset int, key string, file string")
    got = sorted(tuple(r) for r in warc.archived(table).collect())
    c = duckdb.connect()
    c.register("pages", table.select("page_id", "url", "html").toPandas())
    want = sorted(c.execute(warc.ORACLE).fetchall())
    assert [tuple(str(v) for v in r) for r in got] == [tuple(str(v) for v in r) for r in want]
    odd = spark.createDataFrame([(None, None, None), (1, "u", "t"), (1, "u", "t")], "page_id bigint, url string, html string")
    assert warc.archived(odd).count() == 3 and warc.archived(odd.limit(0)).count() == 0


def test_licences_of_the_query(spark, tmp_path):
    """op6_licences itself: families, spans and probabilities are those of a scan of each text."""
    texts = [(1, "x\nReleased under the MIT License."), (2, None), (3, ""), (4, "Licensed under the Foo License, version 2."), (5, "All rights reserved. Licensed under CC BY 4.0."), *((k, "tara lomi nera " * 5) for k in range(6, 20))]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licences.op6_licences(spark, str(tmp_path)).collect()}
    model = licences.fit_licences(docs_of(spark, texts))
    for i, t in texts:
        found = model.scan(t)
        known = sorted({c for *_, c, _ in found if c != "unknown"})
        assert got[i]["families"] == ",".join(known) and got[i]["n_paragraphs"] == len(found)
        assert got[i]["spans"] == " ".join(f"{a}:{b}:{c}" for a, b, c, _ in found)
        assert got[i]["licence"] in (known or (["unknown"] if found else ["none"]))
    assert [got[i]["licence"] for i in (1, 2, 3, 4, 6)] == ["mit", "none", "none", "unknown", "none"] and got[5]["families"] == "cc-by,proprietary"


def test_hot_ids_with_equal_beginnings_are_dealt_out(spark):
    """4,000 rows of a null id whose texts begin alike, and a hot id: no task takes them all, and each has a next one."""
    from pyspark.sql import functions as F

    texts = [f"the same beginning of all {k} " + "x" * (k % 50) for k in range(4_000)]
    docs = docs_of(spark, [(None, t) for t in texts] + [(9, t) for t in texts[:2_000]])
    got = lz.spliced_with_next(docs)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6_000 and len(sizes) >= 4 and max(sizes) < 3_000
    rows = got.collect()
    assert sorted(r["n_chars"] for r in rows) == sorted(len(t) for t in texts + texts[:2_000])
    hashes = {r["h"]: r["text"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for i, own in ((9, texts[:2_000]), (None, texts)):
        order = [hashes[h] for h in sorted((h for h, t in hashes.items() if t in set(own)), reverse=True)]
        edited = {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in zip(order, order[1:])}
        assert edited <= {r["edited_sha256"] for r in rows if r["doc_id"] == i}

"""The stored keyword index against BM25 by hand: tenants, phrases, stems, replacement, compaction, failed updates."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions.stem import porter_stem
from lodestone.operators.keyword_index import KeywordIndex, _Search, clauses_of

WORDS = "alpha beta gamma delta red blue state of the art well known report annual".split()


def text(rng):
    return " ".join(rng.choices(WORDS, weights=[1, 2, 3, 4, 5, 6, 7, 30, 30, 3, 2, 2, 2, 1], k=rng.choice([0, 3, 8, 40])))


def tokens(s, stem=None):
    found = re.findall(r"\w+", (s or "").lower())
    return [stem(w) for w in found] if stem else found


def clauses(s, stem=None):
    plain = re.sub(r"[^\w\s?&+-]", " ", s.lower())
    return list(dict.fromkeys(c for part in plain.split() if (c := tuple(tokens(part, stem)))))


def by_hand(docs, queries, k, stem=None, allow_global=False, tenants=True):
    """docs: {id: (tenant, text)}; queries: [(id, text, tenant)]. BM25 over all documents, a row at a time."""
    held = {i: (t, tokens(s, stem)) for i, (t, s) in docs.items()}
    mean = sum(len(w) for _, w in held.values()) / max(1, len(held))
    tf = lambda c, w: sum(tuple(w[j : j + len(c)]) == c for j in range(len(w) - len(c) + 1))
    out = []
    for q, s, tenant in queries:
        no_tenant = tenant in (None, "", "ALL", "*")
        if no_tenant and not allow_global:
            continue
        own = clauses(s, stem)
        n = {c: sum(tf(c, w) > 0 for _, w in held.values()) for c in own}
        found = []
        for i, (t, w) in held.items():
            counts = {c: tf(c, w) for c in own}
            score = sum(max(1e-6, math.log((len(held) - n[c] + 0.5) / (n[c] + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for c, f in counts.items() if f)
            if any(counts.values()) and (no_tenant or t == tenant):
                found.append((all(counts.values()), round(score, 9), i))
        every = [x for x in found if x[0]]
        best = sorted(every or found, key=lambda x: (-x[1], x[2]))[:k]
        out += [(q, r + 1, i, round(score, 6), not every) for r, (_, score, i) in enumerate(best)]
    return sorted(out)


def got(df):
    assert df.columns == ["query_id", "rank", "chunk_id", "score", "fallback_used"]
    return sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in df.collect())


QUERIES = [
    (1, "alpha, beta?", "t0"), (2, "State-of-the-art report", "t1"), (3, "of the", "t2"), (4, "well-known annual-report zzz", "t0"), (5, "zzz", "t0"),
    (6, "--- ? &", "t0"), (7, "alpha beta gamma delta red blue", "t1"), (8, "red", None), (9, "blue red", "ALL"), (10, "the the-of", "*"), (11, "gamma", ""), (12, "gamma", "nobody"),
]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    made = {i: (f"t{rng.choice([0, 0, 1, 2])}", text(rng)) for i in range(400)}
    return made | {400: (None, "red alpha"), 401: ("t0", None), 402: ("t1", "State of the Art report"), 403: ("t1", "art the of state report state-of, the art")}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, (t, s) in docs.items()], "chunk_id bigint, tenant_id string, text string, TERM string, words int")


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id bigint, text string, tenant string")


@pytest.mark.parametrize("stem", [None, porter_stem])
def test_replacing_deleting_and_compacting_equal_a_fresh_index(spark, docs, tmp_path, stem):
    rng = random.Random(9)
    index = KeywordIndex(str(tmp_path / "index"), stem=stem)
    assert got(index.search(asked(spark), 4, tenant="tenant")) == []
    index.update(frame(spark, docs), tenant="tenant_id")
    now = dict(docs)
    for _ in range(2):
        changed = {i: (f"t{rng.choice([0, 1, 2])}", text(rng)) for i in rng.sample(range(430), 60)}
        gone = [(i,) for i in rng.sample(range(430), 30) if i not in changed]
        index.update(frame(spark, changed), spark.createDataFrame(gone, "chunk_id bigint"), tenant="tenant_id")
        now = {i: x for i, x in (now | changed).items() if (i,) not in gone}
    want = by_hand(now, QUERIES, 4, stem, allow_global=True)
    assert got(index.search(asked(spark), 4, tenant="tenant", allow_global=True)) == want
    words = Counter(w for _, s in now.values() for w in set(tokens(s, stem)))
    assert {r["term"]: r["df"] for r in index.terms(spark).collect()} == words
    counted = index.dictionary(spark).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
    assert {r["term"]: r["n"] for r in counted.collect()} == words
    index.compact(spark)
    index.vacuum(spark)
    assert len(index.commits(spark)) == 1
    assert got(index.search(asked(spark), 4, tenant="tenant", allow_global=True)) == want


def test_no_tenant_no_result(spark, docs, tmp_path):
    index = KeywordIndex(str(tmp_path / "index"))
    index.update(frame(spark, docs), tenant="tenant_id")
    one = spark.createDataFrame([(1, "red", None), (2, "red", "ALL")], "query_id bigint, text string, tenant string")
    assert got(index.search(one, 3, tenant="tenant")) == []
    assert got(index.search(one, 3)) == []
    assert len(got(index.search(one, 3, tenant="tenant", allow_global=True))) == 6
    own = got(index.search(one.withColumn("tenant", F.lit("t2")), 3, tenant="tenant", allow_global=True))
    assert own and all(docs[r[2]][0] == "t2" for r in own)


def test_a_failed_update_changes_nothing_and_can_come_again(spark, docs, tmp_path, monkeypatch):
    index = KeywordIndex(str(tmp_path / "index"))
    index.update(frame(spark, docs), tenant="tenant_id")
    before = got(index.search(asked(spark), 4, tenant="tenant"))
    changed = frame(spark, {k: ("t0", "alpha beta gamma") for k in range(50)})

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeywordIndex, "_commit", fails)
        with pytest.raises(OSError):
            index.update(changed, tenant="tenant_id")
    assert got(index.search(asked(spark), 4, tenant="tenant")) == before
    index.update(changed, tenant="tenant_id")
    now = docs | {k: ("t0", "alpha beta gamma") for k in range(50)}
    index.update(changed, tenant="tenant_id")
    assert got(index.search(asked(spark), 4, tenant="tenant")) == by_hand(now, QUERIES, 4)


def test_few_items_are_scored(spark, tmp_path):
    """Of 6,000 items that hold a common word of the query, those that can't win aren't scored."""
    index = KeywordIndex(str(tmp_path / "index"))
    docs = {i: ("t0", "common words here " * (1 + i % 7) + ("rare" if i % 600 == 5 else "")) for i in range(6_000)}
    index.update(frame(spark, docs), tenant="tenant_id")
    queries = [(1, "rare common missing", "t0")]
    found = index.search(spark.createDataFrame(queries, "query_id bigint, text string, tenant string"), 5, tenant="tenant")
    assert got(found) == by_hand(docs, queries, 5)
    asked_ = clauses_of(spark.createDataFrame([(1, "rare common missing")], "query_id bigint, text string")).withColumns({"clause": F.array_join("words", " "), "__tenant": F.lit(None).cast("string")})
    search = _Search(index, spark, asked_, index.commits(spark), 5, True)
    assert 5 <= search.candidates(asked_).count() <= 10


def test_repeated_ids_null_ids_and_empty_batches(spark, tmp_path):
    index = KeywordIndex(str(tmp_path / "index"))
    rows = spark.createDataFrame([(1, "a", "one"), (1, "a", "one"), (2, "a", "two"), (2, "a", "three"), (None, "a", "one")], "chunk_id bigint, tenant_id string, text string")
    index.update(rows, tenant="tenant_id")
    assert sum(r["items"] for r in index.commits(spark)) == 2
    terms = {r["term"] for r in index.terms(spark).collect()}
    assert "one" in terms and len(terms) == 2
    index.update(rows.limit(0), rows.where("chunk_id = 1").select("chunk_id"), tenant="tenant_id")
    assert {r["term"] for r in index.terms(spark).collect()} == terms - {"one"}


def test_stems():
    pairs = "caresses caress ponies poni agreed agre motoring motor hopping hop falling fall filing file happy happi sky sky relational relat conditional condit vietnamization vietnam operator oper triplicate triplic electricity electr goodness good adoption adopt probate probat rate rate controlling control generalizations gener oscillators oscil"
    words = pairs.split()
    assert [porter_stem(w) for w in words[::2]] == words[1::2]
    assert [porter_stem(w) for w in ("is", "été", "x1", "")] == ["is", "été", "x1", ""]

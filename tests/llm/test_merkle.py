"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle
from lodestone.llm.merkle import manifest

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels of digests, the leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(levels, k):
    """(digests before, digests behind) on the way up."""
    out = []
    for level in levels[:-1]:
        own = level[k - k % 16 : k - k % 16 + 16]
        out.append((own[: k % 16], own[k % 16 + 1 :]))
        k //= 16
    return out


def brute(rows, tampered):
    own = {}
    for r in rows:
        own.setdefault(r[1], []).append(r)
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        own[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: tree([leaf_of(r) for r in own[s]]) for s in order}
    tops = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, r in enumerate(own[s]):
            steps = path(trees[s], k) + path(tops, j)
            folded = leaf_of(tampered(r))
            for before, behind in steps:
                folded = sha(*before, folded, *behind)
            out.append((r[0], leaf_of(r), trees[s][-1][0], tops[-1][0], sha(*(x for b, a in steps for x in b + a)), folded, folded == tops[-1][0]))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def lowered(rows_tampered):
    return lambda r: (*r[:4], r[4].lower() if r[4] else r[4]) if r[0] in rows_tampered else r


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    made = [(k, "hot", rng.choice(["en", None]), rng.choice([None, k]), rng.choice([f"Text {k}", "Same", None, "", "É" * 3])) for k in range(300)]
    made += [(1_000 + k, f"s{k % 19}", "de", 5, f"T{k}") for k in range(60)]
    made += [(2_000, "alone", "xx", 0, "LONE"), (2_001, None, None, None, "No source"), (None, None, "a", 1, "B"), (None, "hot", "a", 1, "B"), (2_002, "", "a", 1, "B")]
    made += [(7, "hot", "en", 1, "twice")] * 3 + [(2_003, "é", "en", 2, "X" * 50_000)] + [(None, "hot", None, None, None)] * 20
    return made


@pytest.mark.parametrize("heavy", [merkle.HEAVY, 3])
def test_manifest_is_the_plain_tree(spark, rows, monkeypatch, heavy):
    monkeypatch.setattr(merkle, "HEAVY", heavy)
    chosen = {k for k in range(3_000) if k % 3 == 0}
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS + ", LEAF int, run string").repartition(5)
    made = manifest(docs, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), F.lower("text"))
    assert got(made) == brute(rows, lowered(chosen))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


@pytest.mark.parametrize("some", [slice(0, 1), slice(0, 16), slice(0, 17), slice(0, 257), slice(300, 340)])
def test_sizes_around_the_fan(spark, rows, some):
    own = rows[some]
    assert got(manifest(spark.createDataFrame(own, COLUMNS))) == brute(own, lambda r: r)


def test_empty_table(spark):
    assert got(manifest(spark.createDataFrame([], COLUMNS))) == []


def test_a_changed_row_is_the_only_one_that_fails(spark, rows):
    own = [(k, f"s{k % 3}", "en", 4, f"T{k}") for k in range(100)]
    made = manifest(spark.createDataFrame(own, COLUMNS), F.col("doc_id") == 42, F.lit("other"))
    assert [r["doc_id"] for r in made.where(~F.col("verified")).collect()] == [42]

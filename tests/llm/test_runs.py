"""Periodic runs against brute force, word by word, in batches and as a whole."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm.runs import LEAST_PERIODS, LEAST_WORDS, SquareCatcher, periodic_runs, repeated_from, runs_of


def brute(w):
    """Every lag, every stretch; a stretch counts for its smallest lag."""
    n, found = len(w), {}
    for q in range(1, n // LEAST_PERIODS + 1):
        start = None
        for i in range(q, n + 1):
            same = i < n and w[i] == w[i - q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.setdefault((start - q, i), q)
                start = None
    return sorted((a, e - a, q) for (a, e), q in found.items())


def invented(rng):
    n = rng.choice([0, 5, 23, 24, 25, 60, 120, 300, 700])
    w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a = rng.randrange(n)
            p = rng.choice([1, 2, 3, 7, 8, 9, 13, 16, 17, 31, 33, 64, rng.randrange(1, n)])
            for i in range(a, min(n, a + rng.randrange(1, 6 * p + 30))):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_are_those_of_brute_force_however_words_arrive():
    rng, total = random.Random(12), 0
    for _ in range(400):
        w = invented(rng)
        want = brute(w)
        total += len(want)
        for batch in (10**9, 1, rng.randrange(2, 60)):
            assert runs_of(np.array(w, np.int64), batch) == want
    assert total > 40


def test_squares_are_reported_as_words_arrive():
    w = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] * 4 + [77]
    catcher, seen = SquareCatcher(), []
    for k, x in enumerate([50, 51, *w]):
        for start, end, q in catcher.append(np.array([x])):
            assert end <= k + 1 and end - start >= 2 * q
            seen.append((start, end, q))
    assert {(a, q) for a, _, q in seen} == {(2, 10)}
    ends = [e for _, e, _ in seen]
    assert ends == sorted(set(ends)) or ends[-1] == 42  # the last word ends the streak
    assert max(ends) == 42 and min(ends) <= 2 + 30
    assert catcher.finish() == [(2, 40, 10)]


def test_literal_runs():
    assert runs_of(np.zeros(23, np.int64)) == []
    assert runs_of(np.zeros(24, np.int64)) == [(0, 24, 1)]
    assert runs_of(np.zeros(100_000, np.int64), 999) == [(0, 100_000, 1)]
    assert runs_of(np.arange(30_000) % 9_999, 4_096) == [(0, 30_000, 9_999)]
    assert runs_of(np.arange(29_996) % 9_999) == []
    # Two runs that overlap, and one within the period of another.
    inner = [1] * 24 + list(range(2, 30))
    assert runs_of(np.array(inner * 3)) == [*((len(inner) * k, 24, 1) for k in range(1)), (0, 3 * len(inner), len(inner)), *((len(inner) * k, 24, 1) for k in (1, 2))]


def expected(i, text):
    words = [w for w in (text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(kept))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    rows = [(k, " ".join(f"w{x}" for x in invented(rng))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n\x0b\x0c\r "), (63, "é é\x1c" + " é é\x1c" * 30), (64, "no break " * 40), (None, "x y " * 20), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    return rows


def test_query_rows(spark, texts):
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in texts], "doc_id bigint, text string, period string, N_RUNS int")
    got = periodic_runs(docs, alter=True)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((str(i), *map(str, expected(i, t))) for i, t in texts)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want
    assert sum(repeated_from(1, i) is not None for i, _ in texts) > 3
    assert periodic_runs(docs.limit(0)).count() == 0

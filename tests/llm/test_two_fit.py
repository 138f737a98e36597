"""Best-two-fit: the plan against packing piece by piece, the query against the tokenizers library."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.two_fit import cuts, fill, pack_two_fit, plan, slots


def one_by_one(histogram, window):
    """Best-two-fit on a plain list of pieces, one sequence after the other."""
    items, out = sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True), []
    while items:
        own, room, rest = [], window, []
        for n in items:
            if n <= room:
                own.append(n)
                room -= n
            else:
                rest.append(n)
        items, least = rest, own[-1]
        pairs = [(items[a] + items[b], items[a], a, b) for a in range(len(items)) for b in range(a + 1, len(items)) if least < items[a] + items[b] <= room + least]
        if room and pairs:
            _, _, a, b = max(pairs, key=lambda x: x[:2])
            own[-1:] = [items[a], items[b]]
            items = sorted([*(x for k, x in enumerate(items) if k not in (a, b)), least], reverse=True)
        out.append(own)
    return out


def test_plan_is_piecewise_best_two_fit():
    rng, swapped = random.Random(4), 0
    for _ in range(300):
        window = rng.choice([8, 16, 30])
        histogram = {n: rng.randrange(1, rng.choice([3, 8, 25])) for n in rng.sample(range(1, window + 1), rng.randrange(1, window + 1))}
        planned = plan(histogram, window)
        got = sorted(own for own, times in planned for _ in range(times))
        assert got == sorted(one_by_one(histogram, window))
        assert all(sum(own) <= window for own in got)
        swapped += any(own != sorted(own, reverse=True) or len(own) > 2 for own in got)
    assert swapped


def test_smallest_piece_gives_way_to_a_tighter_pair():
    left = np.zeros(101, np.int64)
    left[[60, 30, 22, 17]] = 1
    assert fill(left, 100) == [60, 22, 17] and left[30] == 1  # greedy alone: 60 + 30, a gap of 10
    assert plan({60: 1, 30: 1, 22: 1, 17: 1}, 100) == [([60, 22, 17], 1), ([30], 1)]
    assert plan({}, 100) == []


def test_large_histograms_are_planned_quickly_and_nearly_without_padding():
    histogram = {n: 1 + 10_000_000 // n for n in range(1, 2049)}
    planned = plan(histogram)
    used = {}
    for own, times in planned:
        for n in own:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    total = sum(n * k for n, k in histogram.items())
    assert sum(times for _, times in planned) <= math.ceil(total / 2048) * 1.001
    assert len(slots(planned)) < 200_000


def test_cuts():
    assert cuts(1) == [(0, 1)] and cuts(2048) == [(0, 2048)] and cuts(2049) == [(0, 1), (1, 2048)]
    assert cuts(4096) == [(0, 2048), (2048, 2048)] and cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_every_id_lies_in_one_piece_and_sequences_have_no_gap(spark, library):
    rng = random.Random(5)
    texts = [(k, " ".join("alpha beta gamma δέλτα 12,5 <|endoftext|>".split()[rng.randrange(6)] for _ in range(rng.choice([0, 3, 40, 400, 2500])))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, "word " * 3), (102, "word " * 3), (103, "x" * 30_000), *((None, None) for _ in range(40))]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "doc_id bigint, text string, LENGTH int, row string")
    got = pack_two_fit(docs, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rest = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        bounds = [0, *([rest] if rest else []), *range(rest + 2048, len(ids) + 1, 2048)]
        want += [(i if i is not None else -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    rows = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64")
    assert sorted(map(tuple, rows.to_numpy().tolist())) == sorted(want)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    histogram = got["length"].value_counts().to_dict()
    assert got["sequence_id"].nunique() == len(one_by_one(histogram, 2048))


def test_empty_table(spark):
    assert pack_two_fit(spark.createDataFrame([], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect() == []

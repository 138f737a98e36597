"""Sitemap expansion, bisected batches, the vector cache, the progress log, report runs."""

import pytest

from lodestone.operators import slots
from lodestone.sources import ingest as I
from lodestone.sources import sinks as S
from lodestone.sources.segments import Segments
from lodestone.streaming.ingest import fold_progress, job_progress, progress_table, stream_progress


# -- sitemaps -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "xml,found",
    [
        ('<urlset xmlns="http://s/0.9"><url><loc> http://h/a.xml </loc></url><url><loc/></url></urlset>', [("http://h/a.xml", False)]),
        ("<sitemapindex><sitemap><loc>http://h/s1</loc></sitemap><url><loc>http://h/x</loc></url></sitemapindex>", [("http://h/s1", True)]),
        ("<feed><loc>http://h/a.XML</loc><loc>http://h/Sitemap-2</loc><x><loc>http://h/p</loc></x></feed>", [("http://h/a.XML", True), ("http://h/Sitemap-2", True), ("http://h/p", False)]),
        ("<urlset/>", []), ("no xml <", []), ("", []), (None, []), ("<?xml version='1.0'?><!-- c --><urlset><url><loc>http://h/?a=1&amp;b=2</loc></url></urlset>", [("http://h/?a=1&b=2", False)]),
    ],
)
def test_locations(xml, found):
    assert [(loc, child) for _, loc, child in I.locations(xml)] == found


def test_expansion_ends_in_cycles_and_at_its_depth(spark):
    index = lambda *xs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in xs) + "</sitemapindex>"
    pages = lambda *xs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in xs) + "</urlset>"
    maps = [("r", index("a", "b", "r", "missing")), ("a", index("c", "r", "a")), ("b", pages("p1", "p2", "p1")), ("c", pages("p2", "p3")), ("s", pages("p1")), ("many", index(*(f"m{k}" for k in range(12))))]
    maps += [(f"m{k}", pages(f"q{k}")) for k in range(12)]
    sitemaps, roots = spark.createDataFrame(maps, "url string, xml string"), spark.createDataFrame([("r",), ("s",), ("many",), ("r",), ("nothing",)], "root string")
    got = lambda depth: {(r["root"], r["url"]): (r["level"], r["sitemap"], r["pos"]) for r in I.expand_sitemaps(roots, sitemaps, depth).collect() if r["root"] != "many"}
    assert got(0) == {("s", "p1"): (0, "s", 0)}
    assert got(1) == got(0) | {("r", "p1"): (1, "b", 0), ("r", "p2"): (1, "b", 1)}
    assert got(9) == got(1) | {("r", "p3"): (2, "c", 1)}
    assert sorted(r["url"] for r in I.expand_sitemaps(roots, sitemaps).where("root = 'many'").collect()) == sorted(f"q{k}" for k in range(10))


# -- encoders that fail ---------------------------------------------------------------------------------------------
def test_only_bad_texts_are_left_out():
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    texts = [f"t{k}" for k in range(64)]
    texts[5] = texts[50] = "bad"
    got = slots.encoded_each(texts, encode)
    assert [k for k, (v, _, _) in enumerate(got) if v is None] == [5, 50]
    assert got[5] == (None, "ValueError: no", slots.RETRIES) and got[6] == ([2.0], None, 1)
    assert len(calls) < 30
    assert slots.encoded_each([], encode) == []
    assert all(v is None for v, _, _ in slots.encoded_each(["a", "b"], lambda t: [[1.0]] if len(t) > 1 else []))


def test_a_passing_failure_is_tried_again():
    seen = []

    def encode(texts):
        seen.append(texts)
        if len(seen) < 3:
            raise OSError("busy")
        return [[1.0]] * len(texts)

    assert slots.encoded_each(["one"], encode) == [([1.0], None, 3)]


def test_failed_rows_go_to_a_retry_table(spark):
    def encode(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [[1.0, 2.0] for _ in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, ""), (4, None), (5, "b")], "id int, text string")
    done = slots.embed_with_status(df, encode)
    assert {r["id"]: r["embedding"] for r in done.collect()} == {1: [1.0, 2.0], 2: None, 3: None, 4: None, 5: [1.0, 2.0]}
    assert [tuple(r) for r in slots.to_retry(done, "id").collect()] == [(2, 3, "ValueError: no")]
    assert slots.embed(df, encode).columns == ["id", "text", "embedding"]


# -- vectors of queries ---------------------------------------------------------------------------------------------
def test_cache_encodes_each_key_once_and_drops_the_first(spark, tmp_path):
    cache, folder = Segments(str(tmp_path / "cache"), ("key",)), str(tmp_path / "calls")

    def encode(texts):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return slots.hashed_vectors(texts)

    def asked(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        return {(r["query_id"], r["text"]): (r["hit"], r["embedding"]) for r in slots.cached_vectors(rows, cache, bound=3, encode=encode).collect()}

    def encoded():
        import glob

        return sorted(line for p in glob.glob(f"{folder}/*") for line in open(p).read().split("\n"))

    one = asked("Red fox", " red FOX ", "blue", None)
    assert [hit for hit, _ in one.values()] == [False] * 4 and one[0, "Red fox"][1] == one[1, " red FOX "][1] and one[3, None][1] is None
    assert encoded() == ["Red fox", "blue"]
    two = asked("BLUE", "green", "white")
    assert two[0, "BLUE"] == (True, one[2, "blue"][1]) and not two[1, "green"][0]
    assert encoded() == ["Red fox", "blue", "green", "white"]
    assert cache.read(spark, "vectors").count() == 3
    three = asked("red fox", "blue", "green", "white")
    assert [hit for hit, _ in three.values()] == [False, True, True, True]
    assert asked(*"abcdef")[0, "a"][1] is not None and cache.read(spark, "vectors").count() == 3
    assert [hit for hit, _ in asked(*"abcdef").values()].count(True) == 3


# -- progress -------------------------------------------------------------------------------------------------------
EVENTS = "job_id int, seq int, status string, pct int"


def test_progress_of_events_in_any_order_is_that_of_the_batch(spark, tmp_path):
    batches = [[(1, 3, "processing", 50), (2, 1, "queued", 5)], [(1, 1, "queued", 5), (1, 2, "processing", 20)], [(2, 2, "failed", 10), (1, 4, "complete", 100)], [(2, 1, "queued", 5)]]
    src, target, mark = (str(tmp_path / n) for n in ("src", "target", "mark"))
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream_progress(spark, src, EVENTS, target, mark).awaitTermination()
        want = job_progress(spark.read.schema(EVENTS).parquet(src)).collect()
        assert sorted(map(tuple, progress_table(spark, target).collect())) == sorted(map(tuple, want))
    before = sorted(map(tuple, progress_table(spark, target).collect()))
    fold_progress(spark, target)
    assert sorted(map(tuple, progress_table(spark, target).collect())) == before
    stream_progress(spark, src, EVENTS, target, mark).awaitTermination()
    assert sorted(map(tuple, progress_table(spark, target).collect())) == before
    fold_progress(spark, target, drop=("complete",))
    assert [r["job_id"] for r in progress_table(spark, target).collect()] == [2]


# -- reports --------------------------------------------------------------------------------------------------------
def test_a_run_counts_once_its_manifest_is_there(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 0.5, [1, 2]), ("b", None, None)], "mode string, `hit at 1` double, parts array<int>")
    plain = metrics.select("mode", "`hit at 1`")
    summary = S.markdown_table(plain, "Modes", "mode")
    folder = str(tmp_path)
    S.write_reports({"metrics": metrics}, f"{folder}/run=half")
    with pytest.raises(Exception, match="manifest"):
        S.read_run(spark, folder, "half", "metrics")
    for _ in range(2):
        S.write_run({"metrics": metrics, "empty": metrics.limit(0)}, summary, folder, "1")
    assert sorted(map(tuple, S.read_run(spark, folder, "1", "metrics").collect())) == [("a", 0.5, [1, 2]), ("b", None, None)]
    assert S.read_run(spark, folder, "1", "empty").count() == 0
    assert [r[0] for r in S.read_run(spark, folder, "1", "summary").collect()] == ["## Modes", "", "| mode | hit at 1 |", "| --- | --- |", "| a | 0.5 |", "| b |  |"]
    assert {r["report"]: r["n_rows"] for r in S.read_run(spark, folder, "1", "manifest").collect()} == {"metrics": 2, "empty": 0, "summary": 6}
    with pytest.raises(KeyError):
        S.read_run(spark, folder, "1", "nothing")

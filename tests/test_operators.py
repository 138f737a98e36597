"""Library operators on literal fixtures and against DuckDB."""

import json
import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.tenants import tenant_guard
from lodestone.operators import chunking as K
from lodestone.operators import cleaning as C
from lodestone.operators import context as X
from lodestone.operators import evaluation as E
from lodestone.operators import observability as O
from lodestone.operators import registry as G
from lodestone.operators import retrieval as R
from lodestone.operators import slots
from lodestone.sources import ingest as I
from lodestone.sources import sinks as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# -- tenant guard ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("tenant", [None, "", "ALL", "*"])
@pytest.mark.parametrize("allowed,n", [(False, 0), (True, 3)])
def test_guard_without_a_tenant(spark, tenant, allowed, n):
    rows = spark.createDataFrame([("t1",), ("t1",), ("t2",)], "tenant string")
    assert rows.where(tenant_guard("tenant", tenant, allowed)).count() == n


@pytest.mark.parametrize("allowed", [False, True])
def test_guard_with_a_tenant(spark, allowed):
    rows = spark.createDataFrame([("t1",), ("t1",), ("t2",), (None,)], "tenant string")
    assert rows.where(tenant_guard("tenant", "t1", allowed)).count() == 2


def test_guarded_plan_reads_nothing(spark):
    plan = spark.range(10).withColumn("t", F.lit("a")).where(tenant_guard("t", None))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan


# -- sources --------------------------------------------------------------------------------------------------------
def test_routes(spark):
    cases = {"https://a.b/sitemap_index": "sitemap", "http://a.b/x.XML?y=1": "sitemap", "http://a.b/x": "web", "/d/x.pdf": "document", "notes.md": "document", "x.csv": "unsupported"}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["k"] for r in rows.select("s", I.route(F.col("s")).alias("k")).collect()} == cases
    assert one(spark, I.route(F.lit("http://a.b/x"), F.lit("application/pdf"))) == "document"


def test_sitemaps(spark):
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://h/docs/a </loc></url><url><loc>http://h/docs/a</loc></url><url><loc>http://h/docs/x.pdf?v=1</loc></url><url><loc>http://h/blog/b</loc></url></urlset>'
    index = '<sitemapindex><sitemap><loc>http://h/s1</loc></sitemap></sitemapindex>'
    locs = I.sitemap_locations(spark.createDataFrame([(1, xml), (2, index), (3, "<urlset/>")], "n int, xml string"))
    assert [(r["n"], r["is_sitemap"]) for r in locs.orderBy("n", "pos").collect()] == [(1, False)] * 4 + [(2, True)]
    urls = locs.where("n = 1").withColumnRenamed("loc", "url")
    assert [r["url"] for r in I.select_urls(urls, "/DOCS/").collect()] == ["http://h/docs/a"]
    assert one(spark, I.robots_sitemaps(F.lit("User-agent: *\nSitemap: http://h/s.xml\nsitemap:  http://h/t.xml"))) == ["http://h/s.xml", "http://h/t.xml"]


def test_gates_in_order(spark):
    rows = spark.createDataFrame([("a", 100, "txt", 10, 0), ("b", 10, "txt", 10, 0), ("c", 2_000_000, "md", 10, 0), ("d", 10, "xls", 10, 0), ("e", 100, "txt", 21 * 1024 * 1024, 0), ("f", 100, "txt", 10, 2000)], "id string, chars int, ext string, size long, n int")
    got = I.gates(rows, F.col("chars"), F.col("ext"), F.col("size"), F.col("n"))
    assert {r["id"]: r["gate_status"] for r in got.collect()} == {"a": "accepted", "b": "rejected", "c": "failed", "d": "rejected", "e": "rejected", "f": "rejected"}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\n\xff ok")
    got = I.text_files(spark, str(tmp_path)).first()
    assert got["title"] == "a.md" and got["text"].startswith("# T\n") and got["text"].endswith(" ok")


def test_promoted_headings(spark):
    f = lambda s: one(spark, T.promote_headings(F.lit(s)))
    assert f("**Setup**\n\ntext") == "## Setup\n\ntext" and f("**Setup**") == "## Setup"
    for s in ("**Setup** text", "**ab**", "**Setup**\ntext", "**Setup:**\n\nx"):
        assert f(s) == s


def test_repeats_and_flags(spark):
    assert one(spark, T.strip_repeats(F.lit("so the old line the old line ends​"))) == "so the old line ends"
    assert one(spark, T.suspicious_text(F.lit("a\nb\n\n"))) and not one(spark, T.suspicious_text(F.lit("long enough")))
    assert one(spark, T.looks_like_log(F.lit("2024-01-01 10:00:07 x\n2024-01-01T10:00:08 y\nz"))) and not one(spark, T.looks_like_log(F.lit("a\nb 10:00:00\nc")))


# -- cleaning -------------------------------------------------------------------------------------------------------
def test_blocks_keep_code_and_tables_whole(spark):
    md = "# H\ntext one\nline two\n\n```py\na\n\nb\n```\nafter\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- item\n```open"
    got = C.parse_blocks(spark.createDataFrame([(1, md)], "doc_id int, markdown string"))
    rows = got.withColumn("kind", C.block_type(F.col("content"))).orderBy("block_idx").collect()
    assert [(r["kind"], r["content"]) for r in rows] == [
        ("heading", "# H"), ("text", "text one\nline two"), ("code", "```py\na\n\nb\n```"), ("text", "after"), ("table", "| a | b |\n|---|---|\n| 1 | 2 |"), ("list", "- item\n```open"),
    ]


CASES = [
    (0.50, 0.00, 0.90, 4, 3, 1.0, 9.5, 2),
    (0.00, 0.50, 0.00, 40, 0, 0.8, -3.0, None),
    (0.96, 0.50, 0.00, 8, 0, 1.0, 5.0, 1),
]


@pytest.mark.parametrize("df,at,density,n,links,uniq,score,tier", CASES)
def test_boilerplate_scores(spark, df, at, density, n, links, uniq, score, tier):
    rows = spark.createDataFrame([(1, 0, "text", "h", n, uniq, links, density, at, df)], "doc_id int, block_idx int, block_type string, block_hash string, word_count int, unique_word_ratio double, link_count int, link_density double, position_ratio double, df double")
    got = C.removal(C.boilerplate_score(rows)).first()
    assert got["score"] == score and got["tier"] == tier
    assert C.removal(C.boilerplate_score(rows.withColumn("block_type", F.lit("code")))).first()["is_removed"] is False


def test_neighbours_that_are_link_walls_count(spark):
    rows = [(1, 0, "text", "a", 20, 1.0, 9, 0.95, 0.0, 0.0), (1, 1, "text", "b", 5, 1.0, 2, 0.9, 0.5, 0.0)]
    table = spark.createDataFrame(rows, "doc_id int, block_idx int, block_type string, block_hash string, word_count int, unique_word_ratio double, link_count int, link_density double, position_ratio double, df double")
    got = C.removal(C.boilerplate_score(table)).orderBy("block_idx").first()
    assert got["score"] == 5.5 and not got["is_removed"] and got["signals"] == ["edge_position", "link_density_high", "context_penalty"]


def test_frequency_of_a_single_document_is_zero(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id int, block_hash string")
    assert {r["df"] for r in C.document_frequency(rows).collect()} == {0.0}


# -- chunking -------------------------------------------------------------------------------------------------------
def test_heading_paths(spark):
    md = "\n".join(f"{'#' * n} {t}" for n, t in [(1, "A"), (2, "B"), (3, "C"), (2, "D"), (4, "E"), (1, "F"), (3, "G")])
    rows = K.section_blocks(spark.createDataFrame([(1, md)], "doc_id int, markdown string")).orderBy("idx").collect()
    assert ["/".join(r["heading_path"]) for r in rows] == ["A", "A/B", "A/B/C", "A/D", "A/D/E", "F", "F/G"]


def test_packing_fixtures():
    t = [100, 300, 250, 50, 50, 400, 700, 20]
    assert K.pack_ranges(t, [False] * 8) == [(0, 1, 400), (2, 4, 350), (3, 5, 500), (6, 6, 700), (7, 7, 20)]
    assert K.pack_ranges([500, 200, 300], [False, True, True]) == [(0, 1, 700), (2, 2, 300)]
    assert K.pack_ranges([], []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.booleans()), max_size=40))
def test_packing_covers_in_order_and_is_bounded(blocks):
    tokens, structured = [b[0] for b in blocks], [b[1] for b in blocks]
    out = K.pack_ranges(tokens, structured)
    assert sorted({i for a, b, _ in out for i in range(a, b + 1)}) == list(range(len(tokens)))
    for a, b, n in out:
        assert n == sum(tokens[a : b + 1]) and (n <= 800 or max(tokens[a : b + 1]) + 125 > 600)


def chunk(path, tokens, kind="text", text="x\ny\nz", heading=False):
    return {"heading_path": path, "tokens": tokens, "content_type": kind, "text": text, "starts_with_heading": heading}


def test_tiny_merges():
    assert K.should_merge(chunk(["A"], 5, text="# A", heading=True), chunk(["A", "B"], 799))
    assert not K.should_merge(chunk(["A"], 30, "table"), chunk(["A"], 30, "table"))
    assert not K.should_merge(chunk(["A"], 100), chunk(["B", "C"], 100))
    assert K.should_merge(chunk([], 100), chunk([], 100)) and not K.should_merge(chunk([], 100), chunk([], 200))
    assert K.should_merge(chunk(["A", "B"], 100), chunk(["A", "C"], 600)) and not K.should_merge(chunk(["A", "B"], 300), chunk(["A", "C"], 300))


def test_documents_to_chunks(spark):
    md = "# A\n\n## B\n\n" + "\n\n".join("word " * 200 for _ in range(5)) + "\n\n```py\nx = 1\n```"
    rows = K.chunk_documents(spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id int, markdown string")).orderBy("chunk_index").collect()
    assert rows[0]["heading_path"] == ["A", "B"] and rows[0]["tiny_merged"] and {r["total_chunks"] for r in rows} == {len(rows)}
    assert rows[-1]["content_type"] == "mixed" and {r["doc_id"] for r in rows} == {1}


def test_truncation(spark):
    text, tokens = K.truncated(F.lit(" ".join(["w"] * 1600)), F.lit(2100))
    got = one(spark, text)
    assert got.endswith("w [TRUNCATED]") and len(got.split()) == 1539 and one(spark, tokens) == 2000


def test_oversize_blocks_are_cut(spark):
    line = "A sentence of some words. " * 60
    rows = [(1, 0, "short", "text"), (1, 1, "\n".join([line] * 4), "text"), (1, 2, "```" + "x" * 6000 + "```", "code"), (2, 0, "word " * 1200 + ". End.", "text")]
    got = K.split_oversize(spark.createDataFrame(rows, "doc_id int, idx int, content string, kind string")).orderBy("doc_id", "idx").collect()
    assert [r["idx"] for r in got if r["doc_id"] == 1] == [0, 1, 2, 3, 4, 5][: len([r for r in got if r["doc_id"] == 1])]
    assert got[0]["content"] == "short" and any(len(r["content"]) > 6000 and r["kind"] == "code" for r in got)
    assert all(len(r["content"]) <= 4000 for r in got if r["kind"] == "text" and r["doc_id"] == 1)


def test_golden_sets(spark, tmp_path):
    from lodestone.sources.golden import load_eval_queries

    (tmp_path / "g.json").write_text(json.dumps([{"query": "a", "difficulty": "hard"}, {"query": "b", "acceptable_documents": ["d"]}]))
    got = {r["query"]: r for r in load_eval_queries(spark, str(tmp_path / "g.json")).collect()}
    assert got["a"]["difficulty"] == "hard" and got["b"]["difficulty"] == "medium" and got["a"]["acceptable_documents"] == [] and got["b"]["category"] == "Concept"


def test_orphan_tables(spark):
    rows = [(1, 0, "|a|b|\n|---|---|\n|1|2|"), (1, 1, "|3|4|\n|5|6|"), (1, 2, "|x|\n|y|"), (1, 3, "text")]
    got = K.merge_orphan_tables(spark.createDataFrame(rows, "doc_id int, idx int, content string")).orderBy("run").collect()
    assert [r["n_blocks"] for r in got] == [2, 1, 1]


# -- retrieval ------------------------------------------------------------------------------------------------------
def test_fusion_fixture(spark):
    dense = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "query_id int, rank int, chunk_id string")
    sparse = spark.createDataFrame([(1, 1, "y"), (1, 2, "w")], "query_id int, rank int, chunk_id string")
    got = [(r["chunk_id"], r["score"]) for r in R.reciprocal_rank_fusion(dense, sparse, 3).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["y", "x", "w"] and got[0][1] == 1.0 and got[1][1] == pytest.approx(62 / 123, abs=1e-6) and got[2][1] == pytest.approx(61 / 123, abs=1e-6)
    assert got == [(r["chunk_id"], r["score"]) for r in R.reciprocal_rank_fusion(sparse, dense, 3).orderBy("rank").collect()]


def test_bm25_fallback_fixture(spark):
    docs = spark.createDataFrame([("c1", "alpha beta"), ("c2", "alpha"), *((f"d{k}", "other words") for k in range(6)), ("n", None)], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "alpha zeta"), (3, "!!!")], "query_id int, text string")
    got = R.bm25_search(R.bm25(R.query_terms(queries), docs.na.fill({"text": ""})), 5).collect()
    assert {(r["query_id"], r["chunk_id"], r["fallback_used"]) for r in got} == {(1, "c1", False), (2, "c1", True), (2, "c2", True)}


def test_rerank_without_scores_keeps_order(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id int, rank int, chunk_id string")
    assert [r["chunk_id"] for r in R.rerank(ranked, F.lit(None).cast("double"), 2).orderBy("rank").collect()] == ["a", "b"]


def test_dense_blocks_agree(spark):
    v = spark.createDataFrame([(k, [math.sin(k), math.cos(k), k % 3 - 1.0]) for k in range(60)], "chunk_id bigint, v array<double>")
    q = v.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    a, b = (sorted(map(tuple, R.dense_top_k(q, v, 4, query_block=n, chunk_block=3 * n).collect())) for n in (1000, 2))
    assert a == b and len(a) == 4 * q.count() and R.dense_top_k(q, v.limit(0), 4).count() == 0 and R.dense_top_k(q.limit(0), v, 4).count() == 0


# -- context, registry, observability -------------------------------------------------------------------------------
def test_context_fixture(spark):
    words = lambda n: " ".join(["w"] * (n * 3 // 4))
    rows = [(1, 1, "a", words(3000)), (1, 2, "b", words(2500) + " b"), (1, 3, "c", words(3000)), (1, 4, "d", words(1500) + " d"), (1, 5, "e", words(600) + " e")]
    got = X.context_rows(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, text string").withColumn("score", F.lit(1.0)))
    assert {r["chunk_id"]: r["disposition"] for r in got.collect()} == {"a": "included", "b": "excluded", "c": "duplicate", "d": "included", "e": "excluded"}


def test_json_and_bands(spark):
    score, reason, band = X.faithfulness(F.lit('```json\n{"score": 0.5, "reasoning": "r"}\n```'), F.lit(False))
    assert (one(spark, score), one(spark, reason), one(spark, band)) == (0.5, "r", "Low")
    score, reason, _ = X.faithfulness(F.lit("no json"), F.lit(False))
    assert one(spark, score) == 0.0 and one(spark, reason) == "unreadable output"
    assert one(spark, X.parse_heading_path(F.lit('["A", "B > C"]'))) == ["A", "B > C"] and one(spark, X.parse_heading_path(F.lit("A >  B "))) == ["A", "B"]


def test_costs_fixture(spark):
    log = spark.createDataFrame([(1, "gemini"), (2, "nobody")], "log_id int, provider string").withColumns({"embedding_tokens": F.lit(1000), "input_tokens": F.lit(2000), "output_tokens": F.lit(500), "rerank_tokens": F.lit(4000)})
    assert [round(r["total_cost"], 9) for r in O.query_costs(log).collect()] == [0.00038, 0.00038]


def test_registry_fixtures(spark):
    docs = spark.createDataFrame([("a", "complete"), ("b", "failed")], "doc_id string, status string")
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert {r["doc_id"]: r["status"] for r in G.registered(docs, new).collect()} == {"a": "complete", "b": "pending", "c": "pending"}
    m = G.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert one(spark, m) == {"a": "1", "b": "3"}
    batch = spark.createDataFrame([(1, "t", "x"), (2, "t", "x"), (3, "u", "x"), (4, "t", None)], "doc_id int, tenant_id string, text string")
    once = G.deduplicated(batch)
    assert sorted(r["doc_id"] for r in once.collect()) == [1, 3, 4] and G.deduplicated(once.drop("content_hash")).count() == 3


def test_matches_and_ranks(spark):
    queries = spark.createDataFrame([(1, ["3.13.html"], ["PEP 703"])], "query_id int, acceptable_documents array<string>, acceptable_headings array<string>")
    url = "https://docs.python.org/3/whatsnew/3.13.html"
    rows = [(1, 1, "http://x", "", []), (1, 2, url, "", ["News"]), (1, 3, url, "", ["News", "PEP 703: Free threading"])]
    m = E.matched(spark.createDataFrame(rows, "query_id int, rank int, url string, section_title string, heading_path array<string>"), queries)
    assert [r["match_type"] for r in m.orderBy("rank").collect()] == [E.NO, E.PARTIAL, E.EXACT]
    r = E.query_ranks(m.select("query_id", "rank", "match_type"), queries).first()
    assert (r["rank"], r["exact_rank"], r["hit1"], r["hit3"], r["best_match"]) == (2, 3, False, True, E.EXACT)


def test_nearest_rank_percentiles(spark):
    r = E.nearest_rank(spark.range(1, 11).withColumn("g", F.lit(1)), "id", {"p50": 0.5, "p95": 0.95}, "g").first()
    assert (r["mean"], r["p50"], r["p95"]) == (5.5, 6, 10)


# -- slots, sinks, streaming ----------------------------------------------------------------------------------------
def test_embedding_slot_marks_failures(spark):
    def encode(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, " "), (4, None)], "id int, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in slots.embed(rows, encode, batch=1).collect()}
    assert got == {1: [1.0], 2: None, 3: None, 4: None}


def test_other_slots(spark):
    assert one(spark, slots.generate(F.lit("x\n[Source: u | Section: a]\nfirst line"))) == "According to u | Section: a: first line"
    assert json.loads(one(spark, slots.judged(F.lit("a b"), F.lit("a c"))))["score"] == 0.5
    assert one(spark, slots.rewritten(F.lit("q"), F.lit("h"), lambda q, h: "")) == "q"
    terms = spark.createDataFrame([("running",), ("cats",), ("class",)], "term string")
    assert {r["term"]: r["stem"] for r in slots.stemmed(terms).collect()} == {"running": "runn", "cats": "cat", "class": "class"}


def test_upserts(spark):
    old = spark.createDataFrame([("t", 1, "a", "old"), ("t", 2, "a", "old"), ("t", 3, "b", "old")], "tenant_id string, chunk_id int, doc_id string, v string")
    new = spark.createDataFrame([("t", 1, "a", "new")], old.schema)
    assert {r["chunk_id"]: r["v"] for r in S.upserted(old, new, ["tenant_id", "chunk_id"]).collect()} == {1: "new", 2: "old", 3: "old"}
    assert {r["chunk_id"]: r["v"] for r in S.upserted(old, new, ["tenant_id", "chunk_id"], replaced="doc_id").collect()} == {1: "new", 3: "old"}


def test_streamed_ingestion_equals_batch(spark, tmp_path):
    from lodestone.streaming.ingest import chunks_of, stored_chunks, stream_ingest

    rows = [(f"t{k % 2}", k, f"http://h/{k}", f"# Title {k}\n\n" + f"word{k} and some more text here. " * 20) for k in range(6)]
    schema = "tenant_id string, doc_id bigint, url string, markdown string"
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for k in range(0, 6, 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(src)
        stream_ingest(spark, src, schema, out, mark).awaitTermination()
    got = {(r["tenant_id"], r["chunk_id"]) for r in stored_chunks(spark, out).collect()}
    assert got == {(r["tenant_id"], r["chunk_id"]) for r in chunks_of(spark.createDataFrame(rows, schema)).collect()} and len(got) >= 6
    stream_ingest(spark, src, schema, out, mark).awaitTermination()
    assert stored_chunks(spark, out).count() == len(got)


def test_batches_know_what_came_before(spark, tmp_path):
    """A tenant's text comes once, whatever the batch; boilerplate is judged by all batches; new texts replace old ones."""
    from lodestone.streaming.ingest import ingest_batch, stored_chunks

    schema = "tenant_id string, doc_id bigint, url string, markdown string"
    page = lambda k, n=20: f"# Title {k}\n\n" + f"word{k} and some more text here. " * n + "\n\n[home](http://h) [news](http://n)"
    first = [("t1", k, f"http://h/{k}", page(k)) for k in range(12)]
    out = str(tmp_path / "chunks")
    ingest_batch(spark.createDataFrame(first, schema), out)
    before = {(r["doc_id"], r["chunk_id"]) for r in stored_chunks(spark, out).collect()}
    assert {i for i, _ in before} == set(range(12)) and not any("[home]" in r["text"] for r in stored_chunks(spark, out).collect())
    # The same texts under other ids, and the batch itself again: nothing. Another tenant may have them.
    ingest_batch(spark.createDataFrame([("t1", 100 + k, u, m) for _, k, u, m in first[:3]], schema), out)
    ingest_batch(spark.createDataFrame(first, schema), out)
    assert {(r["doc_id"], r["chunk_id"]) for r in stored_chunks(spark, out).collect()} == before
    ingest_batch(spark.createDataFrame([("t2", 200, "http://h/200", page(0)), ("t1", 5, "http://h/5", page(77)), ("t1", 13, "http://h/13", page(13))], schema), out)
    after = stored_chunks(spark, out).collect()
    assert {(r["tenant_id"], r["doc_id"]) for r in after} == {("t1", k) for k in [*range(12), 13]} | {("t2", 200)}
    assert all("word77" in r["text"] for r in after if r["doc_id"] == 5) and not any("[home]" in r["text"] for r in after)
    assert len(after) == len({(r["tenant_id"], r["chunk_id"]) for r in after})


def test_strip_repeats_against_plain_expressions(spark):
    import re

    texts = ["the process ran the process ran well", "The process ran the process ran", "one two one two", "über den Fluß gehen über den Fluß gehen", "a\u200bb a b c a b c", None, ""]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.strip_repeats(F.col("t"))).collect()]
    plain = lambda t: re.sub(r"\b(\w+(?:\s+\w+){2,10})\s+\1\b", r"\1", re.sub("[\u200b\u200c\u200d\ufeff\u00ad]", "", t))
    assert got == [None if t is None else plain(t) for t in texts]


def test_percentiles_of_large_groups_are_exact(spark, monkeypatch):
    import numpy as np
    from lodestone.operators import evaluation as E

    monkeypatch.setattr(E, "WHOLE", 100)
    rng = np.random.default_rng(1)
    values = {"a": rng.lognormal(3, 1, 5_000).round(1), "b": np.repeat(7.0, 2_000), "c": rng.random(40), "d": rng.integers(0, 4, 3_000).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    shares = {"p50": 0.5, "p95": 0.95, "p100": 1.0}
    near = {r["g"]: r for r in E.nearest_rank(df, "v", shares, "g").collect()}
    between = {r["g"]: r for r in E.interpolated(df, "v", shares, "g").collect()}
    for g, vs in values.items():
        s = np.sort(vs)
        for k, p in shares.items():
            assert near[g][k] == s[min(len(s) - 1, int(len(s) * p))], (g, k)
            assert abs(between[g][k] - np.percentile(vs, 100 * p)) < 1e-9, (g, k)


def test_token_counts_by_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two three", "", None, "supercalifragilistic " * 50]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", slots.token_counts(F.col("t"), slots.bpe_counter(path)).alias("n")).orderBy("k").collect()
    library = Tokenizer.from_file(path)
    assert [r["n"] for r in got] == [None if t is None else len(library.encode(t).ids) for t in texts]


def test_low_scores_are_excluded_not_lost(spark):
    rows = [(1, 1, "a", "one two", 0.9), (1, 2, "b", "three", 0.1), (2, 1, "c", "four", 0.2)]
    got = X.context_rows(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, text string, score double"), least=0.5)
    assert {(r["chunk_id"], r["disposition"]) for r in got.collect()} == {("a", "included"), ("b", "excluded"), ("c", "excluded")}
    assert [r["query_id"] for r in X.empty_contexts(got).collect()] == [2]


def test_streamed_job_progress(spark, tmp_path):
    from lodestone.streaming.ingest import job_progress

    rows = [(1, 1, "queued", 5), (1, 2, "processing", 50), (2, 1, "queued", 5), (1, 3, "complete", 100)]
    schema = "job_id int, seq int, status string, pct int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "e"))
    q = job_progress(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["job_id"]: (r["status"], r["progress_pct"]) for r in spark.sql("select * from progress").collect()} == {1: ("complete", 100), 2: ("queued", 5)}


def test_reports(spark, tmp_path):
    S.write_reports({"metrics": spark.range(2)}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2 and os.listdir(tmp_path) == ["metrics"]

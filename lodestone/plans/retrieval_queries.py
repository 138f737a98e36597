"""Registered queries: embedding, dense and keyword retrieval, fusion, evaluation.

The queries are the ``benchmark`` passages; a document is relevant if it holds the passage. Tenants are the
documents' sources and the vectors' labels.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.tenants import tenant_guard
from lodestone.functions import text as T
from lodestone.functions.text import WORD, has_sublist, identifier_tokens
from lodestone.operators import evaluation as E
from lodestone.operators import retrieval as R
from lodestone.operators.slots import embed
from lodestone.operators.keyword_index import KeywordIndex, clauses_of
from lodestone.plans.common import lit, query, table
from lodestone.sources.store import files_key, new_folder, settled, shared_folder

K = 5


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), F.col("label").alias("tenant"))


def vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("tenant"))


def passages(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("tenant_id"))


def _dense_sql(score: str, where: str = "q.vec_id <> c.vec_id", k: int = K) -> str:
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({score}, 9) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND {where})
SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}"""


_COSINE = "list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))"


@query("dense_topk", _dense_sql(_COSINE, "true"))
def dense_topk(spark, d):
    return R.dense_top_k(vector_queries(spark, d), vectors(spark, d), K)


@query("dense_topk_l2", _dense_sql("1 / (1 + list_distance(q.v, c.v))", "true"))
def dense_topk_l2(spark, d):
    return R.dense_top_k(vector_queries(spark, d), vectors(spark, d), K, "l2")


@query("dense_topk_ip", _dense_sql("list_dot_product(q.v, c.v)", "true"))
def dense_topk_ip(spark, d):
    return R.dense_top_k(vector_queries(spark, d), vectors(spark, d), K, "ip")


@query("dense_topk_tenant", _dense_sql(_COSINE, "q.label = c.label"))
def dense_topk_tenant(spark, d):
    return R.dense_top_k(vector_queries(spark, d), vectors(spark, d), K, tenant="tenant")


@query("chunk_neighbors", _dense_sql(_COSINE))
def chunk_neighbors(spark, d):
    return R.dense_top_k(vector_queries(spark, d), vectors(spark, d), K, exclude_self=True)


@query("tenant_guard", "SELECT 'src1' AS asked, count(*) AS n FROM documents WHERE source = 'src1' UNION ALL SELECT 'all', count(*) FROM documents UNION ALL SELECT 'none', 0")
def tenant_guard_(spark, d):
    docs = table(spark, d, "documents")
    cases = (("src1", "src1", False), ("all", None, True), ("none", "ALL", False))
    parts = [docs.where(tenant_guard("source", t, g)).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n") for name, t, g in cases]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("embedding_report", "SELECT label, count(*) AS n, count(*) FILTER (embedding IS NULL) AS failures, CAST(max(len(embedding)) AS INT) AS dim FROM embeddings GROUP BY label")
def embedding_report(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("failures"), F.max(F.size("embedding")).alias("dim"))


@query("embed_status", "SELECT label AS doc_id, count(*) AS n, count(*) FILTER (embedding[1] > 0.25) AS failed, CASE WHEN bool_and(embedding[1] <= 0.25) THEN 'complete' ELSE 'partial_success' END AS status FROM embeddings GROUP BY label")
def embed_status(spark, d):
    v = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("embedding")[0] <= 0.25, F.col("embedding")))
    ok = F.col("embedding").isNotNull()
    return v.groupBy(F.col("label").alias("doc_id")).agg(F.count("*").alias("n"), F.count_if(~ok).alias("failed"), F.when(F.bool_and(ok), "complete").otherwise("partial_success").alias("status"))


@query("dedup_queries", "SELECT md5(lower(trim(text))) AS key, min(conv_id * 100 + turn) AS first_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def dedup_queries(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy(F.md5(F.lower(F.trim("text"))).alias("key")).agg(F.min(F.col("conv_id") * 100 + F.col("turn")).alias("first_id"), F.count("*").alias("n"))


# -- keywords -------------------------------------------------------------------------------------------------------
_POSTINGS = f"p AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), {lit(WORD)})) AS term FROM documents) GROUP BY ALL)"
_TERMS = rf"t AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s?&+-]', ' ', 'g'), {lit(WORD)}))) AS term FROM benchmark)"
_BM25 = f"""{_POSTINGS}, {_TERMS}, dl AS (SELECT doc_id AS chunk_id, len(regexp_extract_all(lower(text), {lit(WORD)})) AS dl FROM documents), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
n AS (SELECT term, count(*) AS n FROM p GROUP BY term), nt AS (SELECT query_id, count(*) AS n_terms FROM t GROUP BY query_id),
b AS (SELECT query_id, chunk_id, round(sum(greatest({R.IDF_FLOOR}, ln((n_docs - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS n_matched
  FROM t JOIN p USING (term) JOIN n USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id),
a AS (SELECT b.*, n_terms, n_matched = n_terms AS every, bool_or(n_matched = n_terms) OVER (PARTITION BY query_id) AS has_all FROM b JOIN nt USING (query_id)),
sparse0 AS (SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score, fallback_used FROM (SELECT query_id, chunk_id, score, NOT has_all AS fallback_used, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a WHERE every OR NOT has_all) WHERE score > 0),
sparse AS (SELECT * FROM sparse0 WHERE rank <= {K})"""


@query("inverted_index", f"WITH {_POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def inverted_index(spark, d):
    return R.postings(documents(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("query_terms", f"WITH {_TERMS} SELECT * FROM t")
def query_terms(spark, d):
    return R.query_terms(passages(spark, d))


@query("sparse_topk_stored", f"WITH {_BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score, fallback_used FROM sparse")
def sparse_topk_stored(spark, d):
    """The same searches, answered from the stored index."""
    found = keyword_index(spark, d).search(passages(spark, d), K, allow_global=True, phrases=False)
    return found.withColumn("score", F.round("score", 6))


def keyword_index(spark, d):
    """The stored index over a folder's documents: built once, then read as long as their files stay the same."""
    key = files_key(spark, f"{d}/documents.parquet")
    index = KeywordIndex(f"{shared_folder(spark)}/keyword-index-{key}", nulls=False)
    if not index.commits(spark):
        index.update(documents(spark, d), tenant="tenant_id")
    return index


def sparse(spark, d, k=K):
    """The best ``k`` documents of each passage, by one pass over the documents."""
    return R.bm25_search(_bm25(spark, d, k), k)


def _bm25(spark, d, best=None):
    return R.bm25(R.query_terms(passages(spark, d)), documents(spark, d), best=best)


@query("bm25_and", f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score FROM a WHERE every")
def bm25_and(spark, d):
    return _bm25(spark, d).where("n_matched = n_terms").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("bm25_fallback", f"WITH {_BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score, fallback_used FROM sparse")
def bm25_fallback(spark, d):
    return sparse(spark, d, K).withColumn("score", F.round("score", 6))


@query("sparse_topk", f"WITH {_BM25} SELECT query_id, 'sparse' AS mode, rank, chunk_id, round(score, 6) AS score FROM sparse")
def sparse_topk(spark, d):
    s = sparse(spark, d, K)
    return s.select("query_id", F.lit("sparse").alias("mode"), "rank", "chunk_id", F.round("score", 6).alias("score"))


def _search_sql(clauses: str, tenant: str = "NULL", phrases: bool = False) -> str:
    """SQL of the search over the view ``c`` (doc_id, words, tenant, whose words stand between blanks) and clauses (query_id, clause, tenant)."""
    return f"""q AS ({clauses}), ws AS (SELECT chunk_id, tenant, len(w) AS dl, ' ' || array_to_string(w, '  ') || ' ' AS s FROM c), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM ws),
tfs AS (SELECT clause, chunk_id, tenant, dl, (length(s) - length(replace(s, ' ' || replace(clause, ' ', '  ') || ' ', ''))) // (length(replace(clause, ' ', '  ')) + 2) AS tf FROM (SELECT DISTINCT clause FROM q) JOIN ws ON contains(s, ' ' || replace(clause, ' ', '  ') || ' ')),
n AS (SELECT clause, count(*) AS n FROM tfs GROUP BY clause), nc AS (SELECT query_id, count(*) AS n_clauses FROM q GROUP BY query_id),
b AS (SELECT query_id, chunk_id, round(sum(greatest({R.IDF_FLOOR}, ln((n_docs - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS n_matched
  FROM q JOIN tfs USING (clause) JOIN n USING (clause), st WHERE q.tenant IS NULL OR q.tenant = tfs.tenant GROUP BY query_id, chunk_id),
a AS (SELECT b.*, n_matched = n_clauses AS every, bool_or(n_matched = n_clauses) OVER (PARTITION BY query_id) AS has_all FROM b JOIN nc USING (query_id))
SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score, fallback_used FROM (SELECT query_id, chunk_id, score, NOT has_all AS fallback_used, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a WHERE every OR NOT has_all) WHERE rank <= {K} AND score > 0"""


_WORDS_OF = f"regexp_extract_all(lower(text), {lit(WORD)})"
_PLAIN = r"regexp_replace(lower(text), '[^\p{L}\p{N}_\s?&+-]', ' ', 'g')"
_HELD_DOCS = f"c AS (SELECT doc_id AS chunk_id, source AS tenant, {_WORDS_OF} AS w FROM documents)"


@query(
    "sparse_topk_tenant",
    "WITH " + _HELD_DOCS + ", " + _search_sql(f"SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all({_PLAIN}, {lit(WORD)}))) AS clause, 'src' || item_id % 22 AS tenant FROM benchmark"),
)
def sparse_topk_tenant(spark, d):
    """Each passage searched by one tenant (two of the 22 have no document), by the statistics of all."""
    asked = passages(spark, d).withColumn("tenant", F.concat(F.lit("src"), F.col("query_id") % 22))
    return keyword_index(spark, d).search(asked, K, tenant="tenant", phrases=False).withColumn("score", F.round("score", 6))


#: Passages as queries with two phrases: their first two words and their last three, joined by hyphens, and a single word;
#: those of fewer than four words ask nothing.
_HYPHENS = f"SELECT item_id AS query_id, w[1] || '-' || w[2] || ' ' || w[4] || ' ' || w[-3] || '-' || w[-2] || '-' || w[-1] AS text FROM (SELECT item_id, {_WORDS_OF} AS w FROM benchmark)"


def _hyphenated(spark, d):
    w = T.words(F.col("text"))
    at = lambda k: F.try_element_at(w, F.lit(k))
    hyphen, blank = F.lit("-"), F.lit(" ")
    return passages(spark, d).select("query_id", F.concat(at(1), hyphen, at(2), blank, at(4), blank, at(-3), hyphen, at(-2), hyphen, at(-1)).alias("text"))


@query(
    "phrase_topk",
    f"WITH {_HELD_DOCS}, h AS ({_HYPHENS}), "
    + _search_sql(f"SELECT DISTINCT query_id, array_to_string(regexp_extract_all(part, {lit(WORD)}), ' ') AS clause, NULL AS tenant FROM (SELECT query_id, unnest(string_split_regex({_PLAIN}, '\\s+')) AS part FROM h) WHERE len(regexp_extract_all(part, {lit(WORD)})) > 0"),
)
def phrase_topk(spark, d):
    """Queries in which words joined by hyphens must stand in a row."""
    return keyword_index(spark, d).search(_hyphenated(spark, d), K, allow_global=True).withColumn("score", F.round("score", 6))


@query("phrase_clauses", f"WITH h AS ({_HYPHENS}) SELECT DISTINCT query_id, array_to_string(regexp_extract_all(part, {lit(WORD)}), ' ') AS clause FROM (SELECT query_id, unnest(string_split_regex({_PLAIN}, '\\s+')) AS part FROM h) WHERE len(regexp_extract_all(part, {lit(WORD)})) > 0")
def phrase_clauses(spark, d):
    return clauses_of(_hyphenated(spark, d)).select("query_id", F.array_join("words", " ").alias("clause"))


_REVISED = "SELECT doc_id, CASE WHEN source IN ('src3', 'src4') THEN 'revised ' || lang || ' ' || text ELSE text END AS text FROM documents WHERE source <> 'src5'"


@query("keyword_index_update", f"WITH p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS_OF}) AS term FROM ({_REVISED})) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def keyword_index_update(spark, d):
    """An index over all documents after two sources came again with other texts and a third was deleted."""
    index = KeywordIndex(new_folder(spark, "keyword-index"))
    docs = documents(spark, d)
    index.update(docs, tenant="tenant_id")
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    again = docs.where(F.col("tenant_id").isin("src3", "src4")).join(lang, "chunk_id").withColumn("text", F.concat(F.lit("revised "), "lang", F.lit(" "), "text"))
    index.update(again, docs.where("tenant_id = 'src5'"), tenant="tenant_id")
    return index.terms(spark)


# The dense list: texts and passages as vectors of hashed word counts, the default encoder's.
def _vectors_sql(name: str, item: str, table_: str) -> str:
    two = lambda at: f"16 * (strpos('0123456789abcdef', substr(h, {at}, 1)) - 1) + strpos('0123456789abcdef', substr(h, {at + 1}, 1)) - 1"
    return f"""{name} AS (SELECT id, list_transform(range(64), lambda k: CAST(coalesce(m[k], 0) AS DOUBLE)) AS v FROM (SELECT id, map_from_entries(list((p, c))) AS m FROM (
  SELECT id, p, sum(s) AS c FROM (SELECT id, CAST(({two(1)}) % 64 AS BIGINT) AS p, CASE WHEN {two(3)} < 128 THEN 1 ELSE -1 END AS s FROM (SELECT {item} AS id, md5(unnest(regexp_extract_all(lower(text), {lit(WORD)}))) AS h FROM {table_})) GROUP BY id, p) GROUP BY id))"""


_DENSE = f"""{_vectors_sql("dv", "doc_id", "documents")}, {_vectors_sql("pv", "item_id", "benchmark")},
dense0 AS (SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.id AS query_id, c.id AS chunk_id, round(list_dot_product(q.v, c.v) / greatest(sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 1e-300), 9) AS score FROM pv q CROSS JOIN dv c)) WHERE rank <= {4 * K}),
dense AS (SELECT * FROM dense0 WHERE rank <= {K})"""


def _embedded(spark, d):
    """(passages, documents) with vectors; texts without a word have none."""
    words = F.size(T.words(F.col("text"))) > 0
    q = embed(passages(spark, d).where(words)).select("query_id", F.col("embedding").alias("qv"))
    return q, embed(documents(spark, d).where(words)).select("chunk_id", F.col("embedding").alias("v"))


def _dense(spark, d, k=K):
    return R.dense_top_k(*_embedded(spark, d), k)


@query("dense_text_topk", f"WITH {_DENSE} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM dense")
def dense_text_topk(spark, d):
    return _dense(spark, d).withColumn("score", F.round("score", 6))


def _fused_sql(name: str, dense: str, sparse: str, k: int) -> str:
    return f"""{name}0 AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT query_id, rank, chunk_id FROM {dense} UNION ALL SELECT query_id, rank, chunk_id FROM {sparse}) GROUP BY ALL),
{name} AS (SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score / best, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM {name}0) WHERE rank <= {k})"""


_FUSED = f"{_BM25}, {_DENSE}, sparse4 AS (SELECT * FROM sparse0 WHERE rank <= {4 * K}), {_fused_sql('fused', 'dense', 'sparse', K)}, {_fused_sql('wide', 'dense0', 'sparse4', 4 * K)}"


def _lists(spark, d):
    """Dense and keyword rankings, four times as long as what is asked for: a reranker chooses among them."""
    return _dense(spark, d, 4 * K), sparse(spark, d, 4 * K)


@query("hybrid_rrf", f"WITH {_FUSED} SELECT * FROM fused")
def hybrid_rrf(spark, d):
    return R.reciprocal_rank_fusion(_dense(spark, d), sparse(spark, d, K), K)


_QW, _TW = f"regexp_extract_all(lower(q.text), {lit(WORD)})", f"regexp_extract_all(lower(x.text), {lit(WORD)})"
_RERANKED = f"""{_FUSED}, rr AS (SELECT f.query_id, f.chunk_id, f.rank AS before, round(len(list_intersect(list_distinct({_QW}), {_TW})) / len(list_distinct({_QW})), 6) AS score FROM wide f JOIN benchmark q ON q.item_id = f.query_id JOIN documents x ON x.doc_id = f.chunk_id),
reranked AS (SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score, before FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM rr) WHERE rank <= {K})"""


def _candidates(spark, d):
    """What either list has of each query, with both ranks, whether the document holds the passage, and their shared words."""
    dense, sparse = (r.select("query_id", "chunk_id", F.col("rank").alias(n)) for r, n in zip(_lists(spark, d), ("dense", "sparse")))
    met = dense.join(sparse, ["query_id", "chunk_id"], "full").join(passages(spark, d).withColumnRenamed("text", "passage"), "query_id").join(documents(spark, d), "chunk_id")
    kind = F.when(F.contains("text", "passage"), E.EXACT).otherwise(E.NO)
    return settled(met.select("query_id", "chunk_id", "dense", "sparse", kind.alias("match_type"), R.term_overlap(F.col("passage"), F.col("text")).alias("overlap")))


def _list(found, name, k=K):
    return found.where(F.col(name) <= k).select("query_id", "chunk_id", F.col(name).alias("rank"))


def _wide(found):
    """The fused ranking that a reranker chooses from, four times as long as its choice."""
    return R.reciprocal_rank_fusion(_list(found, "dense", 4 * K), _list(found, "sparse", 4 * K), 4 * K)


def _reranked(found):
    return R.rerank(_wide(found).join(found.select("query_id", "chunk_id", "overlap"), ["query_id", "chunk_id"]), F.col("overlap"), K)


@query("rerank_topk", f"WITH {_RERANKED} SELECT * FROM reranked")
def rerank_topk(spark, d):
    return _reranked(_candidates(spark, d))


@query("compare_rankings", f"WITH {_RERANKED} SELECT coalesce(f.query_id, r.query_id) AS query_id, coalesce(f.chunk_id, r.chunk_id) AS chunk_id, f.rank AS rank_before, r.rank AS rank_after, f.rank - r.rank AS gain FROM wide f FULL JOIN reranked r ON f.query_id = r.query_id AND f.chunk_id = r.chunk_id")
def compare_rankings(spark, d):
    found = _candidates(spark, d)
    return R.compare(_wide(found), _reranked(found))


# -- evaluation -----------------------------------------------------------------------------------------------------
_HITS = f"""{_RERANKED}, modes AS (SELECT 'dense' AS mode, query_id, rank, chunk_id FROM dense UNION ALL SELECT 'sparse', query_id, rank, chunk_id FROM sparse UNION ALL SELECT 'hybrid', query_id, rank, chunk_id FROM fused UNION ALL SELECT 'rerank', query_id, rank, chunk_id FROM reranked),
hits AS (SELECT mode, query_id, rank, chunk_id, contains(x.text, q.text) AS hit FROM modes m JOIN benchmark q ON q.item_id = m.query_id JOIN documents x ON x.doc_id = m.chunk_id),
ranks AS (SELECT mode, item_id AS query_id, coalesce(min(CASE WHEN hit THEN rank END), -1) AS rank FROM (SELECT DISTINCT mode FROM modes) CROSS JOIN benchmark LEFT JOIN hits ON hits.mode = mode AND hits.query_id = item_id GROUP BY ALL)""".replace(
    "FROM (SELECT DISTINCT mode FROM modes) CROSS JOIN benchmark LEFT JOIN hits ON hits.mode = mode AND hits.query_id = item_id GROUP BY ALL",
    "FROM (SELECT DISTINCT mode FROM modes) CROSS JOIN benchmark LEFT JOIN (SELECT mode, query_id AS item_id, rank, hit FROM hits) USING (mode, item_id) GROUP BY ALL",
)
_REPORT = "count(*) AS n_queries, round(avg(CAST(rank BETWEEN 1 AND 1 AS INT)), 6) AS hit_at_1, round(avg(CAST(rank BETWEEN 1 AND 3 AS INT)), 6) AS hit_at_3, round(avg(CAST(rank BETWEEN 1 AND 5 AS INT)), 6) AS hit_at_5, round(avg(CASE WHEN rank > 0 THEN 1 / rank ELSE 0.0 END), 6) AS mrr"


def modes(found):
    """The four modes' rankings from the candidates."""
    dense, sparse = _list(found, "dense"), _list(found, "sparse")
    return {"dense": dense, "sparse": sparse, "hybrid": R.reciprocal_rank_fusion(dense, sparse, K), "rerank": _reranked(found)}


def _matches(spark, d, ranked):
    pairs = ranked.join(passages(spark, d).withColumnRenamed("text", "passage"), "query_id").join(documents(spark, d), "chunk_id")
    return pairs.withColumn("match_type", F.when(F.contains("text", "passage"), E.EXACT).otherwise(E.NO))


def _ranks(spark, d, ranked):
    return E.query_ranks(_matches(spark, d, ranked).select("query_id", "rank", "match_type"), passages(spark, d))


def _mode_ranks(spark, d):
    """The rank of each query's first hit in each mode: (mode, query_id, rank, hit1, hit3, hit5)."""
    own, found, out = ["rank", "hit1", "hit3", "hit5"], _candidates(spark, d), passages(spark, d).select("query_id")
    ranked = modes(found)
    for mode, r in ranked.items():
        met = r.select("query_id", "chunk_id", "rank").join(found.select("query_id", "chunk_id", "match_type"), ["query_id", "chunk_id"])
        out = out.join(E.query_ranks(met, passages(spark, d)).select("query_id", F.struct(*own).alias(mode)), "query_id")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("of")) for m in ranked])).alias("x")
    return out.select("query_id", each).select("x.mode", "query_id", "x.of.*")


@query("entry", f"WITH {_HITS} SELECT query_id, rank, chunk_id, hit FROM hits WHERE mode = 'sparse'")
def entry(spark, d):
    """BM25 over all documents for every benchmark passage, and whether the document holds it."""
    s = sparse(spark, d, K).select("query_id", "rank", "chunk_id")
    return _matches(spark, d, s).select("query_id", "rank", "chunk_id", (F.col("match_type") == E.EXACT).alias("hit"))


@query("query_ranks", f"WITH {_HITS} SELECT mode, query_id, rank FROM ranks")
def query_ranks(spark, d):
    return _mode_ranks(spark, d).select("mode", "query_id", "rank")


@query("ablation", f"WITH {_HITS} SELECT mode, {_REPORT} FROM ranks GROUP BY mode")
def ablation(spark, d):
    return E.report(_mode_ranks(spark, d), "mode")


@query("eval_report", f"WITH {_HITS} SELECT {_REPORT} FROM ranks WHERE mode = 'sparse'")
def eval_report(spark, d):
    s = sparse(spark, d, K)
    return E.report(_ranks(spark, d, s))


_GROUPS = "CASE WHEN length(text) < 150 THEN 'easy' WHEN length(text) < 250 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN contains(text, chr(10)) THEN 'lines' ELSE 'line' END AS category"


def _grouped(spark, d):
    n = F.length("text")
    return passages(spark, d).select("query_id", F.col("text").alias("query"), F.when(n < 150, "easy").when(n < 250, "medium").otherwise("hard").alias("difficulty"), F.when(F.contains("text", F.lit("\n")), "lines").otherwise("line").alias("category"))


@query(
    "eval_by_group",
    f"WITH {_HITS}, g AS (SELECT r.*, {_GROUPS} FROM ranks r JOIN benchmark ON item_id = query_id WHERE mode = 'sparse') SELECT 'difficulty' AS dimension, difficulty AS value, {_REPORT} FROM g GROUP BY difficulty UNION ALL SELECT 'category', category, {_REPORT} FROM g GROUP BY category UNION ALL SELECT 'all', 'all', {_REPORT} FROM g",
)
def eval_by_group(spark, d):
    s = sparse(spark, d, K)
    results = _ranks(spark, d, s).join(_grouped(spark, d), "query_id")
    return E.group_metrics(results, "difficulty", "category")


@query("rerank_regressions", f"WITH {_HITS} SELECT a.query_id, a.rank AS pre, b.rank AS post, b.rank - a.rank AS delta, b.rank IS NULL AS fell_off FROM (SELECT * FROM ranks WHERE mode = 'sparse' AND rank > 0) a LEFT JOIN (SELECT * FROM ranks WHERE mode = 'rerank' AND rank > 0) b USING (query_id) WHERE b.rank IS NULL OR b.rank > a.rank")
def rerank_regressions(spark, d):
    r = _mode_ranks(spark, d)
    return E.rerank_regressions(r.where("mode = 'sparse'"), r.where("mode = 'rerank'"))


@query("evidence_report", f"WITH {_HITS} SELECT item_id AS query_id, chunk_id, CASE WHEN hit THEN 'Exact Match' ELSE 'No Match' END AS match_type FROM benchmark LEFT JOIN (SELECT * FROM hits WHERE mode = 'sparse' AND rank = 1) h ON h.query_id = item_id")
def evidence_report(spark, d):
    s = sparse(spark, d, K)
    return E.evidence(passages(spark, d), _matches(spark, d, s))


@query(
    "review_sample",
    f"WITH {_HITS}, m AS (SELECT query_id, CASE WHEN rank > 0 THEN 'Exact Match' ELSE 'No Match' END AS best_match, CAST(rank AS INT) AS rank FROM ranks WHERE mode = 'sparse') SELECT query_id, best_match, rank, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY best_match ORDER BY md5('0:' || query_id), query_id) AS nth FROM m) WHERE nth <= 5",
)
def review_sample(spark, d):
    s = sparse(spark, d, K)
    results = _ranks(spark, d, s)
    return E.review_sample(results).select("query_id", "best_match", "rank", "nth")


@query("normalize_ids", "SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS tokens FROM pages")
def normalize_ids(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(identifier_tokens(F.col("url")), " ").alias("tokens"))


@query(
    "token_sublist",
    "WITH t AS (SELECT page_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' ' AS s FROM pages) SELECT page_id, contains(s, ' example com ') AS com, contains(s, ' en ') AS en FROM t",
)
def token_sublist(spark, d):
    tokens = identifier_tokens(F.col("url"))
    return table(spark, d, "pages").select("page_id", has_sublist(tokens, identifier_tokens(F.lit("example.com"))).alias("com"), has_sublist(tokens, identifier_tokens(F.lit("/en/"))).alias("en"))


@query(
    "match_chunks",
    """WITH t AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' ' AS s FROM pages),
m AS (SELECT page_id, CASE WHEN contains(url, 'example.org/en') THEN 'example.org/en' WHEN contains(url, '.html') THEN '.html' WHEN contains(s, ' net ') THEN 'NET' END AS target, CASE WHEN contains(url, 'example.org/en') OR contains(url, '.html') THEN 'Exact Substring Match' WHEN contains(s, ' net ') THEN 'Normalized Token Sublist Match' END AS rule, contains(s, ' www ') AS heading FROM t)
SELECT page_id, CASE WHEN target IS NULL THEN 'No Match' WHEN heading THEN 'Exact Match' ELSE 'Partial Match' END AS match_type, rule AS matching_rule, target AS matched_target FROM m""",
)
def match_chunks(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.lit(0).alias("query_id"), "url", F.col("url").alias("section_title"), F.array().cast("array<string>").alias("heading_path"))
    queries = spark.range(1).select(F.lit(0).alias("query_id"), F.array(F.lit("example.org/en"), F.lit(".html"), F.lit("NET")).alias("acceptable_documents"), F.array(F.lit("www")).alias("acceptable_headings"))
    return E.matched(pages, queries).select("page_id", "match_type", "matching_rule", "matched_target")


@query(
    "dataset_integrity",
    f"WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 9 = 0 THEN (SELECT min(text) FROM benchmark) ELSE text END AS query, item_id % 4 AS m FROM benchmark), d AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY query_id) AS n FROM q) SELECT query_id, 'duplicate query' AS problem FROM d WHERE n > 1 UNION ALL SELECT query_id, 'no acceptable documents' FROM d WHERE m = 1 UNION ALL SELECT query_id, 'no topic' FROM d WHERE m = 2 UNION ALL SELECT query_id, 'no category' FROM d WHERE m = 3",
)
def dataset_integrity(spark, d):
    q = passages(spark, d)
    first = q.agg(F.min("text").alias("first"))
    m = F.col("query_id") % 4
    golden = q.crossJoin(F.broadcast(first)).select(
        "query_id",
        F.when(F.col("query_id") % 9 == 0, F.col("first")).otherwise(F.col("text")).alias("query"),
        F.when(m == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("acceptable_documents"),
        F.when(m == 2, "Unknown").otherwise("t").alias("expected_topic"),
        F.lit("easy").alias("difficulty"),
        F.when(m == 3, " ").otherwise("c").alias("category"),
    )
    return E.integrity(golden)


@query("run_fingerprint", "SELECT md5(string_agg(md5(text), '' ORDER BY item_id)) AS dataset_md5, count(*) AS n_queries, 'bm25' AS mode, '5' AS k FROM benchmark")
def run_fingerprint(spark, d):
    return E.fingerprint(passages(spark, d).withColumnRenamed("text", "query"), {"mode": "bm25", "k": "5"})


@query(
    "latency_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN k = CAST(floor(n * 0.5) AS BIGINT) THEN value END) AS p50, max(CASE WHEN k = CAST(floor(n * 0.95) AS BIGINT) THEN value END) AS p95 FROM r GROUP BY event_type""",
)
def latency_percentiles(spark, d):
    return E.nearest_rank(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")

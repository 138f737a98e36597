"""Registered queries: chunking, context, registry, observability, streaming.

Jobs and logs come from ``events``: a user is a job, an event a status change or a logged query. Documents are
registered per source, which is their tenant.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.operators import chunking as K
from lodestone.operators import context as X
from lodestone.operators import observability as O
from lodestone.operators import registry as G
from lodestone.operators import retrieval as R
from lodestone.operators.slots import cached_vectors, embed, embed_with_status, hashed_vectors, rewritten
from lodestone.plans import retrieval_queries as Q
from lodestone.plans.common import BLOCKS, HASH, KIND, MD, lit, markdown_docs, query, sql_tokens, sql_word_count, table
from lodestone.sources.golden import parse_eval_queries
from lodestone.sources.ingest import pages_to_documents
from lodestone.sources.segments import Segments
from lodestone.sources.sinks import markdown_table, read_run, write_run
from lodestone.sources.store import new_folder
from lodestone.streaming.ingest import block_counts, chunk_store, ingest_batch, job_progress, progress_table, stream_ingest, stream_progress

# -- chunking -------------------------------------------------------------------------------------------------------
_LINES = f"lines AS (SELECT doc_id, content, idx - 1 AS idx, {sql_tokens('content')} AS tokens FROM (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


def line_blocks(spark, d):
    """Lines of ``documents`` as text blocks of one section each."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "content"))
    blocks = rows.withColumns({"kind": F.lit("text"), "sec_idx": F.lit(0), "heading_path": F.array().cast("array<string>")})
    return K.with_tokens(blocks)


@query("token_counts", f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("token_estimate", f"SELECT conv_id, turn, {sql_tokens('text')} AS tokens FROM conversations")
def token_estimate_(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))


@query("token_budget", f"SELECT doc_id, tokens <= 600 AS fits, CAST(greatest(0, 600 - tokens) AS INT) AS remaining, tokens >= 600 AS should_start FROM (SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents)")
def token_budget(spark, d):
    t = token_counts(spark, d)
    return t.select("doc_id", (F.col("tokens") <= 600).alias("fits"), F.greatest(F.lit(0), 600 - F.col("tokens")).alias("remaining"), (F.col("tokens") >= 600).alias("should_start"))


@query(
    "heading_paths",
    rf"""WITH {BLOCKS}, h AS (SELECT *, {KIND} AS kind, CASE WHEN {KIND} = 'heading' THEN length(regexp_extract(content, '^(#{{1,6}})\s+\S', 1)) ELSE 0 END AS level FROM blocks),
t AS (SELECT *, CASE WHEN level > 0 THEN trim(regexp_replace(content, '^#{{1,6}}\s+|\s*#+$', '', 'g')) END AS title FROM h),
a AS (SELECT *, {', '.join(f"sum(CAST(level > 0 AND level < {k} AS INT)) OVER (PARTITION BY doc_id ORDER BY block_idx) AS a{k}" for k in range(1, 7))} FROM t),
p AS (SELECT doc_id, block_idx, level, {', '.join(f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, a{k} ORDER BY block_idx) AS h{k}" for k in range(1, 7))} FROM a)
SELECT doc_id, block_idx AS idx, CAST(level AS INT) AS level, concat_ws(' > ', h1, h2, h3, h4, h5, h6) AS path FROM p""",
)
def heading_paths(spark, d):
    return K.section_blocks(markdown_docs(spark, d)).select("doc_id", "idx", "level", F.array_join("heading_path", " > ").alias("path"))


@query("section_blocks", f"WITH {_LINES} SELECT doc_id, CAST(idx AS INT) AS idx, tokens, CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM lines")
def section_blocks(spark, d):
    return line_blocks(spark, d).select("doc_id", "idx", "tokens", "char_start")


# The greedy fold as a recursive query: c tokens so far, s the first block of the open chunk; carried text moves s back.
_PACKED = f"""{_LINES}, pre AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(idx) OVER (PARTITION BY doc_id) AS last_idx FROM lines),
back AS (SELECT a.doc_id, a.idx, coalesce(min(b.idx), a.idx) AS start FROM pre a LEFT JOIN pre b ON b.doc_id = a.doc_id AND b.idx < a.idx AND a.before - b.before <= 125 GROUP BY a.doc_id, a.idx),
fold AS (
  SELECT doc_id, idx, CAST(0 AS BIGINT) AS s, CAST(tokens AS BIGINT) AS c, CAST(NULL AS BIGINT) AS done_first, CAST(NULL AS BIGINT) AS done_tokens FROM pre WHERE idx = 0
  UNION ALL
  SELECT p.doc_id, p.idx, CASE WHEN f.c + p.tokens > 600 THEN greatest(b.start, f.s) ELSE f.s END,
    CAST(CASE WHEN f.c + p.tokens > 600 THEN p.before - q.before + p.tokens ELSE f.c + p.tokens END AS BIGINT),
    CASE WHEN f.c + p.tokens > 600 THEN f.s END, CASE WHEN f.c + p.tokens > 600 THEN f.c END
  FROM fold f JOIN pre p ON p.doc_id = f.doc_id AND p.idx = f.idx + 1 JOIN back b ON b.doc_id = p.doc_id AND b.idx = p.idx
  JOIN pre q ON q.doc_id = p.doc_id AND q.idx = CASE WHEN f.c + p.tokens > 600 THEN greatest(b.start, f.s) ELSE f.s END),
packed AS (SELECT doc_id, CAST(done_first AS INT) AS first, CAST(idx - 1 AS INT) AS last, CAST(done_tokens AS INT) AS tokens FROM fold WHERE done_first IS NOT NULL
  UNION ALL SELECT f.doc_id, CAST(s AS INT), CAST(f.idx AS INT), CAST(c AS INT) FROM fold f JOIN pre p ON p.doc_id = f.doc_id AND p.idx = f.idx AND p.idx = p.last_idx)"""


@query("pack_chunks", f"WITH RECURSIVE {_PACKED} SELECT * FROM packed")
def pack_chunks(spark, d):
    return K.pack(line_blocks(spark, d)).select("doc_id", "first", "last", "tokens")


@query("chunk_overlap", f"WITH RECURSIVE {_PACKED} SELECT doc_id, first, last, CAST(greatest(0, prev - first + 1) AS INT) AS carried FROM (SELECT *, lag(last) OVER (PARTITION BY doc_id ORDER BY last) AS prev FROM packed) WHERE prev IS NOT NULL")
def chunk_overlap(spark, d):
    from pyspark.sql import Window as W

    packed = K.pack(line_blocks(spark, d)).withColumn("prev", F.lag("last").over(W.partitionBy("doc_id").orderBy("last")))
    return packed.where("prev is not null").select("doc_id", "first", "last", F.greatest(F.lit(0), F.col("prev") - F.col("first") + 1).alias("carried"))


@query(
    "chunk_metadata",
    f"WITH RECURSIVE {_PACKED}, c AS (SELECT p.doc_id, p.first, p.last, p.tokens, string_agg(l.content, chr(10) || chr(10) ORDER BY l.idx) AS text, min(l.cs) AS char_start, max(l.cs + length(l.content)) AS char_end FROM packed p JOIN (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs FROM lines) l ON l.doc_id = p.doc_id AND l.idx BETWEEN p.first AND p.last GROUP BY ALL) SELECT doc_id, first, md5(text) AS digest, 'text' AS content_type, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, tokens > 800 AS oversized FROM c",
)
def chunk_metadata(spark, d):
    return K.pack(line_blocks(spark, d)).select("doc_id", "first", F.md5("text").alias("digest"), "content_type", "char_start", "char_end", "oversized")


@query("chunk_ids", f"WITH RECURSIVE {_PACKED} SELECT doc_id, printf('%s_chunk_%03d', md5(CAST(doc_id AS VARCHAR)), row_number() OVER (PARTITION BY doc_id ORDER BY last) - 1) AS chunk_id, count(*) OVER (PARTITION BY doc_id) AS total FROM packed")
def chunk_ids(spark, d):
    from pyspark.sql import Window as W

    packed = K.pack(line_blocks(spark, d))
    return packed.select("doc_id", K.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_in_section")).alias("chunk_id"), F.count("*").over(W.partitionBy("doc_id")).alias("total"))


@query("chunk_stats", f"WITH RECURSIVE {_PACKED} SELECT coalesce(source, 'all') AS source, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (tokens > 800) AS oversized FROM packed JOIN documents USING (doc_id) GROUP BY ROLLUP (source)")
def chunk_stats(spark, d):
    packed = K.pack(line_blocks(spark, d)).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return packed.rollup("source").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"), F.count_if("oversized").alias("oversized")).withColumn("source", F.coalesce("source", F.lit("all")))


@query("ingestion_audit", f"WITH RECURSIVE {_PACKED}, n AS (SELECT doc_id, count(*) AS c, sum(tokens) AS t FROM packed GROUP BY doc_id) SELECT lang, count(*) AS docs, CAST(sum(c) AS BIGINT) AS text_chunks, CAST(sum(t) AS BIGINT) AS tokens FROM n JOIN documents USING (doc_id) GROUP BY lang")
def ingestion_audit(spark, d):
    n = K.pack(line_blocks(spark, d)).groupBy("doc_id").pivot("content_type", ["text"]).agg(F.count(F.lit(1)).alias("c"), F.sum("tokens").alias("t"))
    j = n.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("text_c").alias("text_chunks"), F.sum("text_t").alias("tokens"))


def _groups_sql(parts: str, most: int, joint: str) -> str:
    """Greedy groups of a list of texts, of at most ``most`` characters unless one alone is longer, as a fold."""
    state = f"list_transform({parts}, lambda part_: {{'done': []::VARCHAR[], 'now': part_}})"
    fits = f"length(a['now']) + 1 + length(b['now']) <= {most}"
    fold = f"list_reduce({state}, lambda a, b: CASE WHEN {fits} THEN {{'done': a['done'], 'now': a['now'] || {joint} || b['now']}} ELSE {{'done': list_append(a['done'], a['now']), 'now': b['now']}} END)"
    return f"CASE WHEN len({parts}) = 0 THEN []::VARCHAR[] ELSE list_append(({fold})['done'], ({fold})['now']) END"


def _sentences_sql(expr: str) -> str:
    return f"list_filter(string_split(regexp_replace({expr}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda part_: trim(part_) <> '')"


@query("sentence_pack", f"WITH s AS (SELECT doc_id, {_sentences_sql('text')} AS parts FROM documents), g AS (SELECT doc_id, {_groups_sql('parts', 400, chr(39) + ' ' + chr(39))} AS l FROM s) SELECT doc_id, unnest(l) AS piece, CAST(generate_subscripts(l, 1) - 1 AS INT) AS idx FROM g")
def sentence_pack(spark, d):
    """Sentences of the documents, packed to 400 characters."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(K.sentence_groups(K.sentences(F.col("text")), 400)).alias("idx", "piece"))


@query("merge_tiny_chunks")
def merge_tiny_chunks(spark, d):
    return K.chunk_documents(markdown_docs(spark, d)).select("doc_id", "chunk_index", "total_chunks", "tokens", "content_type", "tiny_merged")


@query("truncate_chunks", f"SELECT doc_id, md5(CASE WHEN t > 2000 THEN array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[:1538], ' ') || ' [TRUNCATED]' ELSE text END) AS digest, CAST(CASE WHEN t > 2000 THEN 2000 ELSE t END AS INT) AS tokens FROM (SELECT *, {sql_tokens('text')} AS t FROM documents)")
def truncate_chunks(spark, d):
    text, tokens = K.truncated(F.col("text"), token_estimate(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), tokens.alias("tokens"))


@query("embedding_text", "SELECT doc_id, '[' || concat_ws(' > ', lang, source || ' > ' || n_chars) || ']' || chr(10) || text AS text FROM documents")
def embedding_text(spark, d):
    return table(spark, d, "documents").select("doc_id", K.embedding_text(F.col("lang"), F.array("source", F.col("n_chars").cast("string")), F.col("text")).alias("text"))


@query("union_visual_chunks", f"SELECT doc_id, 'text' AS content_type, {sql_word_count('text')} AS tokens FROM documents UNION ALL SELECT page_id, 'visual_description', CAST(floor({sql_word_count('html')} * 1.3) AS INT) FROM pages")
def union_visual_chunks(spark, d):
    from lodestone.functions.text import word_count

    text = table(spark, d, "documents").select("doc_id", F.lit("text").alias("content_type"), word_count(F.col("text")).alias("tokens"))
    visual = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("visual_description").alias("content_type"), F.floor(word_count(F.col("html")) * F.lit(1.3)).cast("int").alias("tokens"))
    return text.unionByName(visual, allowMissingColumns=True)


@query(
    "embed_chunks",
    f"""WITH {Q._vectors_sql("dv", "doc_id", "(SELECT DISTINCT doc_id, text FROM documents)")}
SELECT doc_id, CASE WHEN full_ THEN 64 END AS dim, NOT full_ AS failed, CASE WHEN full_ THEN md5(array_to_string(list_transform(coalesce(v, list_transform(range(64), lambda k: 0.0)), lambda x: CAST(x AS INT)), ',')) END AS digest
FROM (SELECT doc_id, coalesce(regexp_matches(text, '[^ \\t\\n\\r]'), false) AS full_ FROM documents) LEFT JOIN dv ON id = doc_id""",
)
def embed_chunks(spark, d):
    done = embed(table(spark, d, "documents").select("doc_id", "text"))
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return done.select("doc_id", size.alias("dim"), F.col("embedding").isNull().alias("failed"), F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("int")), ",")).alias("digest"))


# -- context --------------------------------------------------------------------------------------------------------
# The forty best documents of every passage by keywords.
BEST = 40
_RANKED = f"{Q._BM25}, ranked AS (SELECT query_id, rank, chunk_id, text, score FROM sparse0 JOIN documents ON doc_id = chunk_id WHERE rank <= {BEST})"


def ranked(spark, d):
    best = Q.sparse(spark, d, BEST).select("query_id", "rank", "chunk_id", "score")
    return best.join(Q.documents(spark, d), "chunk_id")


_CONTEXT = f"""{_RANKED}, tk AS (SELECT *, {sql_tokens('text')} AS tokens, sha256(trim(text)) AS h FROM ranked),
fold AS (SELECT query_id, rank, chunk_id, tokens, CASE WHEN tokens <= 5000 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 5000 THEN [h] ELSE [] END AS seen, CASE WHEN tokens <= 5000 THEN 'included' ELSE 'excluded' END AS disposition FROM tk WHERE rank = 1
  UNION ALL SELECT tk.query_id, tk.rank, tk.chunk_id, tk.tokens, CASE WHEN NOT list_contains(seen, h) AND used + tk.tokens <= 5000 THEN used + tk.tokens ELSE used END, CASE WHEN NOT list_contains(seen, h) AND used + tk.tokens <= 5000 THEN list_append(seen, h) ELSE seen END,
    CASE WHEN list_contains(seen, h) THEN 'duplicate' WHEN used + tk.tokens <= 5000 THEN 'included' ELSE 'excluded' END FROM fold f JOIN tk ON tk.query_id = f.query_id AND tk.rank = f.rank + 1)"""


@query("context_window", f"WITH RECURSIVE {_CONTEXT} SELECT query_id, rank, chunk_id, tokens, disposition FROM fold")
def context_window(spark, d):
    return X.context_rows(ranked(spark, d)).select("query_id", "rank", "chunk_id", "tokens", "disposition")


@query("empty_context", f"WITH RECURSIVE {_CONTEXT.replace('5000', '20')}, sums AS (SELECT query_id, count(*) FILTER (disposition = 'included') AS included, count(*) FILTER (disposition = 'excluded') AS excluded FROM fold GROUP BY query_id) SELECT query_id, included, excluded, printf('all %d chunks exceed the budget', excluded) AS message FROM sums WHERE included = 0 AND excluded > 0")
def empty_context(spark, d):
    return X.empty_contexts(X.context_rows(ranked(spark, d), budget=20))


@query("context_text", f"WITH RECURSIVE {_CONTEXT} SELECT query_id, md5(string_agg('[Source: ' || source || ' | Section: ' || lang || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS n_chunks FROM fold JOIN documents ON doc_id = chunk_id WHERE disposition = 'included' GROUP BY query_id")
def context_text(spark, d):
    docs = table(spark, d, "documents")
    rows = X.context_rows(ranked(spark, d)).where("disposition = 'included'").join(docs, F.col("doc_id") == F.col("chunk_id"))
    out = X.context_text(rows.withColumn("cited", X.cited(F.col("source"), F.array("lang"), F.col("text"))))
    return out.select("query_id", F.md5("context_text").alias("digest"), "total_tokens", "n_chunks")


@query("parse_heading_path", r"""SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE list_filter(list_transform(string_split(lang || ' > ' || source, ' > '), lambda x: trim(x)), lambda x: x <> '') END, '/') AS path FROM documents""")
def parse_heading_path(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise(F.concat("lang", F.lit(" > "), "source"))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.parse_heading_path(raw), "/").alias("path"))


_HISTORY = "coalesce(string_agg(upper(left(role, 1)) || lower(role[2:]) || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '')"


@query("history_window", f"SELECT conv_id, turn, {_HISTORY.format(n=6)} AS history FROM conversations")
def history_window(spark, d):
    return X.history(table(spark, d, "conversations")).select("conv_id", "turn", "history")


@query("rewritten_queries", f"SELECT conv_id, turn, CASE WHEN history = '' THEN text ELSE text || ' | ' || split_part(history, chr(10), 1) END AS query FROM (SELECT *, {_HISTORY.format(n=6)} AS history FROM conversations) WHERE role = 'user'")
def rewritten_queries(spark, d):
    """Follow-ups with the first line of what was said before; without a history the model fails and the query stands."""

    def with_history(q, h):
        if not h:
            raise ValueError("no history")
        return None if q is None else f"{q} | {h.splitlines()[0]}"

    turns = X.history(table(spark, d, "conversations")).where("role = 'user'")
    return turns.select("conv_id", "turn", rewritten(F.col("text"), F.col("history"), with_history).alias("query"))


@query("build_prompts", f"WITH h AS (SELECT conv_id, turn, role, text, {_HISTORY.format(n=5)} AS past FROM conversations) SELECT conv_id, turn, 'Answer from the context only. If it doesn''t hold the answer, say so. Cite sources by their headers.' || CASE WHEN past <> '' THEN chr(10) || chr(10) || 'Conversation:' || chr(10) || past ELSE '' END || chr(10) || chr(10) || 'Context:' || chr(10) || role || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM h WHERE role = 'user'")
def build_prompts(spark, d):
    t = X.history(table(spark, d, "conversations"), 5).where("role = 'user'")
    return t.select("conv_id", "turn", X.prompt(F.col("text"), F.col("role"), F.col("history")).alias("prompt"))


@query("extract_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def extract_json(spark, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", X.json_of(fenced, "k int")["k"].alias("k"))


@query("faithfulness_bands", "WITH j AS (SELECT event_id, event_type = 'error' AS failed, CASE WHEN event_type = 'view' THEN NULL ELSE (event_id % 11) / 10 END AS s FROM events), f AS (SELECT event_id, CASE WHEN failed OR s IS NULL THEN 0.0 ELSE s END AS score, CASE WHEN failed THEN 'generation failed' WHEN s IS NULL THEN 'unreadable output' ELSE 'r' END AS reason FROM j) SELECT event_id, round(score, 6) AS score, reason, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.6 THEN 'Partial' ELSE 'Low' END AS band FROM f")
def faithfulness_bands(spark, d):
    e = table(spark, d, "events")
    output = F.when(F.col("event_type") == "view", "no json").otherwise(F.format_string('{"score": %s, "reasoning": "r"}', ((F.col("event_id") % 11) / 10).cast("string")))
    score, reason, band = X.faithfulness(output, F.col("event_type") == "error")
    return e.select("event_id", F.round(score, 6).alias("score"), reason.alias("reason"), band.alias("band"))


@query("source_previews", "SELECT doc_id, source AS url, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def source_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("url"), X.preview(F.col("text")).alias("preview"))


@query("usage_fallback", "SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN length(text) // 4 ELSE turn END AS BIGINT) AS tokens FROM conversations")
def usage_fallback(spark, d):
    reported = F.when(F.col("turn") % 2 == 1, F.col("turn")).otherwise(F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", X.usage(reported, F.col("text")).cast("bigint").alias("tokens"))


@query("validate_requests", "WITH n AS (SELECT source AS tenant_id, count(*) AS n_docs FROM documents GROUP BY source) SELECT conv_id, turn, CASE WHEN NOT length(text) BETWEEN 1 AND 2000 THEN 'query length' WHEN NOT (conv_id % 23) BETWEEN 1 AND 20 THEN 'top_k' WHEN turn * 4 > 20 THEN 'history' WHEN coalesce(n_docs, 0) = 0 THEN 'empty workspace' END AS problem FROM (SELECT *, 'src' || conv_id % 25 AS tenant_id FROM conversations) LEFT JOIN n USING (tenant_id)")
def validate_requests(spark, d):
    c = table(spark, d, "conversations")
    requests = c.select("conv_id", "turn", F.col("text").alias("query"), (F.col("conv_id") % 23).alias("top_k"), (F.col("turn") * 4).alias("n_history"), F.concat(F.lit("src"), F.col("conv_id") % 25).alias("tenant_id"))
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("tenant_id")).agg(F.count("*").alias("n_docs"))
    return X.validated(requests, counts).select("conv_id", "turn", "problem")


# -- registry -------------------------------------------------------------------------------------------------------
_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"
_EVENTS = f"ev AS (SELECT user_id AS job_id, event_id AS seq, ts, {_STATUS} AS status, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error, CAST(json_extract_string(props, '$.k') AS INT) AS pct FROM events)"
_JOBS = f"""{_EVENTS}, jobs AS (SELECT job_id, arg_max(status, seq) AS status, max_by(struct_pack(e := error), seq).e AS error, CASE WHEN arg_max(status, seq) = 'complete' THEN 100 ELSE max(pct) END AS progress_pct, min(ts) AS created_at, CASE WHEN arg_max(status, seq) IN ('complete', 'failed') THEN arg_max(ts, seq) END AS finished_at, count(*) AS n_events FROM ev GROUP BY job_id)"""
_REG = "reg AS (SELECT doc_id, source AS tenant_id, CASE doc_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'processing' END AS status, CAST(1 + n_chars // 2000 AS INT) AS n_chunks FROM documents)"


def job_events(spark, d):
    return as_job_events(table(spark, d, "events"))


def as_job_events(events):
    t = F.col("event_type")
    status = F.when(t == "signup", "queued").when(t.isin("view", "click"), "processing").when(t == "purchase", "complete").otherwise("failed")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.when(t == "error", F.concat(F.lit("error "), "event_id")).alias("error"), F.get_json_object("props", "$.k").cast("int").alias("pct"))


def registered_docs(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in ("complete", "pending", "failed", "processing")]), (F.col("doc_id") % 4 + 1).cast("int"))
    n = (1 + F.floor(F.col("n_chars") / 2000)).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.col("doc_id").cast("string"), F.lit("_"), i.cast("string")))
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_id"), "source", status.alias("status"), n.alias("n_chunks"), ids.alias("chunk_ids"), F.lit(None).cast("string").alias("error"))


@query("upsert_documents", f"WITH {_REG}, n AS (SELECT DISTINCT doc_id FROM labels UNION SELECT -1 - page_id FROM pages) SELECT coalesce(reg.doc_id, n.doc_id) AS doc_id, CASE WHEN status = 'complete' THEN 'complete' WHEN n.doc_id IS NOT NULL THEN 'pending' ELSE status END AS status FROM reg FULL JOIN n ON reg.doc_id = n.doc_id")
def upsert_documents(spark, d):
    new = table(spark, d, "labels").select("doc_id").union(table(spark, d, "pages").select(-1 - F.col("page_id")))
    return G.registered(registered_docs(spark, d), new)


@query("job_state", f"WITH {_JOBS} SELECT * FROM jobs")
def job_state(spark, d):
    return G.job_state(job_events(spark, d))


@query("job_outcomes", f"WITH {_JOBS}, {_REG} SELECT doc_id, coalesce(j.status, reg.status) AS status, j.error FROM reg LEFT JOIN (SELECT * FROM jobs WHERE status IN ('complete', 'failed')) j ON job_id = doc_id")
def job_outcomes(spark, d):
    jobs = G.job_state(job_events(spark, d)).withColumnRenamed("job_id", "doc_id")
    return G.with_job_outcome(registered_docs(spark, d), jobs).select("doc_id", "status", "error")


@query("reset_stuck_jobs", f"WITH {_JOBS} SELECT job_id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'processing') THEN 'interrupted' ELSE error END AS error FROM jobs")
def reset_stuck_jobs(spark, d):
    return G.reset_stuck(G.job_state(job_events(spark, d))).select("job_id", "status", "error")


@query("merge_metadata", "SELECT event_id, CAST(user_id AS VARCHAR) AS a, event_type AS b, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS c FROM events")
def merge_metadata(spark, d):
    old = F.create_map(F.lit("a"), F.col("user_id").cast("string"), F.lit("c"), F.lit("old"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("event_type"), F.lit("c"), F.lit("new"))).otherwise(F.create_map(F.lit("b"), F.col("event_type")))
    m = G.merged_metadata(old, new)
    return table(spark, d, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("dedup_documents", "WITH h AS (SELECT doc_id, source AS tenant_id, sha256(text) AS content_hash FROM documents) SELECT min(doc_id) AS doc_id, tenant_id, content_hash FROM h WHERE doc_id % 3 <> 0 AND (tenant_id, content_hash) NOT IN (SELECT (tenant_id, content_hash) FROM h WHERE doc_id % 3 = 0) GROUP BY tenant_id, content_hash".replace("(tenant_id, content_hash) NOT IN (SELECT (tenant_id, content_hash) FROM h WHERE doc_id % 3 = 0)", "NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id % 3 = 0 AND o.tenant_id = h.tenant_id AND o.content_hash = h.content_hash)"))
def dedup_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_id"), "text")
    complete = docs.where("doc_id % 3 = 0").select("tenant_id", F.sha2("text", 256).alias("content_hash"))
    return G.deduplicated(docs.where("doc_id % 3 <> 0"), complete).select("doc_id", "tenant_id", "content_hash")


@query("lookup_by_source", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def lookup_by_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("tenant_id"))
    wanted = docs.where(F.col("source").isin("src1", "src2")).select("source", F.lit(None).cast("string").alias("tenant_id")).distinct()
    return G.looked_up(docs, wanted).select("doc_id", "source")


@query("lookup_document", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id = 7")
def lookup_document(spark, d):
    return table(spark, d, "events").where("event_id = 7").select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("tenant_quota", f"WITH {_REG} SELECT tenant_id, CAST(sum(n_chunks) AS BIGINT) AS n_chunks FROM reg GROUP BY tenant_id")
def tenant_quota(spark, d):
    return G.tenant_quota(registered_docs(spark, d))


@query("tenant_tokens", f"SELECT source AS tenant_id, CAST(sum({sql_tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY source")
def tenant_tokens(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("tenant_id")).agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))


@query("workspace_stats", f"WITH {_REG} SELECT tenant_id, count(*) AS n_docs, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM reg JOIN documents USING (doc_id) GROUP BY tenant_id")
def workspace_stats(spark, d):
    docs = registered_docs(spark, d).join(table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("tokens")), "doc_id")
    return G.workspace_stats(docs)


@query("list_documents", r"SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS title FROM pages")
def list_documents(spark, d):
    return table(spark, d, "pages").select("page_id", G.title_of(F.col("url")).alias("title"))


_CHUNKS = f"{_REG}, ch AS (SELECT doc_id, tenant_id, i AS chunk_index, doc_id || '_' || i AS chunk_id FROM reg, unnest(range(n_chunks)) AS u(i))"


def stored_chunks(spark, d):
    docs = registered_docs(spark, d)
    return docs.select("doc_id", "tenant_id", F.posexplode("chunk_ids").alias("chunk_index", "chunk_id"))


@query("delete_cascade", f"WITH {_CHUNKS}, g AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND source <> 'src3') SELECT 'documents' AS kind, count(*) AS n FROM reg WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'jobs', count(*) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'chunks', count(*) FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM g)")
def delete_cascade(spark, d):
    docs = registered_docs(spark, d)
    gone = docs.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("tenant_id") == "src3", "other").otherwise(F.col("tenant_id")).alias("tenant_id"))
    jobs = job_events(spark, d).select(F.col("job_id").alias("doc_id")).distinct()
    left = dict(zip(("documents", "jobs", "chunks"), G.delete_cascade(docs, jobs, stored_chunks(spark, d), gone)))
    out = None
    for name, t in left.items():
        part = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("rebuild_registry", f"WITH {_CHUNKS} SELECT doc_id, tenant_id, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids FROM ch GROUP BY ALL")
def rebuild_registry(spark, d):
    return G.rebuilt(stored_chunks(spark, d)).select("doc_id", "tenant_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("consistency_check", f"WITH {_CHUNKS} SELECT reg.doc_id, n_chunks AS registered, count(k.chunk_id) AS stored FROM reg LEFT JOIN (SELECT * FROM ch WHERE (doc_id + chunk_index) % 7 <> 0) k ON k.doc_id = reg.doc_id GROUP BY ALL HAVING n_chunks <> count(k.chunk_id)")
def consistency_check(spark, d):
    return G.consistency(registered_docs(spark, d), stored_chunks(spark, d).where("(doc_id + chunk_index) % 7 <> 0"))


@query("job_status_view", f"WITH {_JOBS}, {_REG} SELECT job_id AS doc_id, jobs.status, CASE WHEN jobs.status = 'complete' THEN coalesce(n_chunks, 0) END AS chunk_count FROM jobs LEFT JOIN reg ON doc_id = job_id")
def job_status_view(spark, d):
    jobs = G.job_state(job_events(spark, d)).withColumnRenamed("job_id", "doc_id")
    return G.job_view(jobs, registered_docs(spark, d)).select("doc_id", "status", "chunk_count")


@query("document_ids", "SELECT page_id, md5('t' || page_id % 3 || '_' || url) AS doc_id FROM pages")
def document_ids(spark, d):
    return table(spark, d, "pages").select("page_id", G.document_id(F.concat(F.lit("t"), F.col("page_id") % 3), F.col("url")).alias("doc_id"))


# -- observability --------------------------------------------------------------------------------------------------
_LOG = """lg AS (SELECT event_id AS log_id, 't' || user_id % 10 AS tenant_id, ts, value * 10 AS latency_ms, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE event_type WHEN 'click' THEN 'groq' WHEN 'view' THEN 'other' ELSE 'gemini' END AS provider FROM events),
cost AS (SELECT *, k * 10 * 2e-8::DOUBLE AS embedding_cost, k * 20 / 1000 * CASE provider WHEN 'groq' THEN 5e-5::DOUBLE ELSE 7.5e-5::DOUBLE END AS input_cost, k * 5 / 1000 * CASE provider WHEN 'groq' THEN 8e-5::DOUBLE ELSE 3e-4::DOUBLE END AS output_cost, k * 40 / 1000 * 1.5e-5::DOUBLE AS rerank_cost FROM lg)"""


def query_log(spark, d):
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int")
    provider = F.when(F.col("event_type") == "click", "groq").when(F.col("event_type") == "view", "other").otherwise("gemini")
    return e.select(F.col("event_id").alias("log_id"), F.concat(F.lit("t"), F.col("user_id") % 10).alias("tenant_id"), "ts", (F.col("value") * 10).alias("latency_ms"), (k * 10).alias("embedding_tokens"), (k * 20).alias("input_tokens"), (k * 5).alias("output_tokens"), (k * 40).alias("rerank_tokens"), provider.alias("provider"))


@query("query_costs", f"WITH {_LOG} SELECT log_id, provider, round(embedding_cost + input_cost + output_cost + rerank_cost, 9) AS total_cost FROM cost")
def query_costs(spark, d):
    return O.query_costs(query_log(spark, d)).select("log_id", "provider", F.round("total_cost", 9).alias("total_cost"))


@query("apply_faithfulness", "SELECT event_id AS log_id, CASE WHEN toxic IS NOT NULL THEN toxic / 1.0 ELSE value END AS faithfulness, CASE WHEN toxic IS NOT NULL THEN 'q' || quality END AS reasoning FROM events LEFT JOIN labels ON doc_id = event_id")
def apply_faithfulness(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("value").alias("faithfulness"), F.create_map(F.lit("type"), "event_type").alias("details"))
    scores = table(spark, d, "labels").select(F.col("doc_id").alias("log_id"), F.col("toxic").cast("double").alias("faithfulness"), F.concat(F.lit("q"), "quality").alias("reasoning"))
    return O.with_late_scores(log, scores).select("log_id", "faithfulness", F.col("details")["reasoning"].alias("reasoning"))


@query("log_summary", f"WITH {_LOG}, r AS (SELECT *, embedding_cost + input_cost + output_cost + rerank_cost AS total_cost, row_number() OVER (PARTITION BY tenant_id ORDER BY log_id DESC) AS n FROM cost) SELECT tenant_id, count(*) AS n_queries, round(sum(total_cost), 6) AS total_cost, round(avg(total_cost), 6) AS avg_cost, round(avg(latency_ms), 2) AS avg_latency_ms FROM r WHERE n <= 100 GROUP BY tenant_id")
def log_summary(spark, d):
    return O.log_summary(O.query_costs(query_log(spark, d)))


@query("pipeline_events", "SELECT event_id, event_type AS event, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def pipeline_events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("event"), "ts", F.from_json("props", "k int")["k"].alias("k"))


@query("latency_trend", f"WITH {_LOG} SELECT tenant_id, log_id, latency_ms, CAST(n AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY log_id DESC) AS n FROM lg) WHERE n <= 20")
def latency_trend(spark, d):
    return O.latest(query_log(spark, d), 20).select("tenant_id", "log_id", "latency_ms", "nth")


@query("stage_durations", "SELECT event_type AS event, count(*) AS n, round(avg(value), 4) AS avg_ms, round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms FROM events GROUP BY event_type")
def stage_durations(spark, d):
    return O.stage_durations(table(spark, d, "events").select(F.col("event_type").alias("event"), F.col("value").alias("duration_ms")))


@query("job_progress", f"WITH {_EVENTS} SELECT job_id, arg_max(status, seq) AS status, max(pct) AS progress_pct, count(*) AS n_events FROM ev GROUP BY job_id")
def job_progress_(spark, d):
    return job_progress(job_events(spark, d))


# -- golden sets and streams ----------------------------------------------------------------------------------------
@query(
    "load_eval_queries",
    "SELECT item_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'topic' ELSE 'Unknown' END AS expected_topic, 'concept' AS expected_content_type, CASE WHEN item_id % 3 = 0 THEN 'a,b' ELSE '' END AS acceptable_documents, '' AS acceptable_headings, 'medium' AS difficulty, 'Concept' AS category FROM benchmark",
)
def load_eval_queries(spark, d):
    fields = F.struct(F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "topic").alias("expected_topic"), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("acceptable_documents"))
    found = parse_eval_queries(table(spark, d, "benchmark").select("item_id", F.to_json(fields).alias("record")))
    return found.withColumns({c: F.array_join(c, ",") for c in ("acceptable_documents", "acceptable_headings")})


_OVERSIZE = f"""WITH d AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, text, CASE WHEN length(text) > 5000 AND NOT starts_with(text, '#') AND NOT starts_with(text, '```') THEN {_groups_sql('parts', 3000, 'chr(10)')} ELSE [text] END AS l FROM d)),
s AS (SELECT doc_id, i, piece, length(text) > 5000 AND length(piece) > 4000 AS long, {_sentences_sql('piece')} AS parts FROM l),
p AS (SELECT doc_id, i, unnest(g) AS content, generate_subscripts(g, 1) AS j FROM (SELECT doc_id, i, CASE WHEN long THEN {_groups_sql('parts', 4000, chr(39) + ' ' + chr(39))} ELSE [piece] END AS g FROM s))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INT) AS idx, content FROM p"""


@query("split_oversize", _OVERSIZE)
def split_oversize(spark, d):
    """Whole documents as one block each, cut at lines and sentences, in the row."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(K.cut_blocks(F.array("text"))).alias("idx", "content"))


def _page_documents(pages):
    return pages_to_documents(pages).select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("tenant_id"), F.col("page_id").alias("doc_id"), "url", "markdown")


def _ingested(spark, d):
    """A store with all pages, read as a stream."""
    target, mark = new_folder(spark, "chunks"), new_folder(spark, "mark")
    stream_ingest(spark, f"{d}/pages.parque[t]", table(spark, d, "pages").schema, target, mark, prepare=_page_documents).awaitTermination()
    return target


@query("stream_ingest")
def stream_ingest_(spark, d):
    """Pages as a stream, cleaned, chunked, embedded and stored; the chunks afterwards, with their texts and vectors."""
    chunks = chunk_store(_ingested(spark, d)).read(spark, "chunks")
    return chunks.select("tenant_id", "doc_id", "chunk_id", "tokens", "content_type", "text", F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("int")), ",")).alias("vector_digest"))


_FIRST = "SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM md0 QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1), markdown ORDER BY doc_id) = 1"
_REVISED = f"{MD.replace('md AS (', 'md0 AS (', 1)}, md AS (SELECT doc_id, url, title, host, CASE WHEN contains(host, '.org') THEN markdown || chr(10) || chr(10) || 'Revised page.' ELSE markdown END AS markdown FROM ({_FIRST}) WHERE NOT contains(host, '.net'))"


def _revised(spark, d):
    """The store after pages of one kind of hosts came again with another text, twice, and those of another kind were deleted."""
    target = _ingested(spark, d)
    docs = _page_documents(table(spark, d, "pages"))
    of = lambda part: docs.where(F.contains("tenant_id", F.lit(part)))
    ingest_batch(of(".org").withColumn("markdown", F.concat("markdown", F.lit("\n\nDraft."))), target)
    ingest_batch(of(".org").withColumn("markdown", F.concat("markdown", F.lit("\n\nRevised page."))), target, deleted=of(".net"))
    return target


@query("ingest_retractions", f"WITH {BLOCKS.replace(MD, _REVISED)} SELECT {HASH} AS block_hash, count(DISTINCT doc_id) AS n FROM blocks GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM md")
def ingest_retractions(spark, d):
    """In how many documents each block stands after changes and deletions, from signed counts."""
    return block_counts(spark, _revised(spark, d))


@query("ingest_documents", f"WITH {_REVISED} SELECT host AS tenant_id, doc_id, sha256(markdown) AS content_hash FROM md")
def ingest_documents(spark, d):
    """Which texts the store holds after changes and deletions."""
    return chunk_store(_revised(spark, d)).read(spark, "documents").select("tenant_id", "doc_id", "content_hash")


@query(
    "vector_log",
    "SELECT label AS tenant_id, vec_id AS chunk_id, round(CASE WHEN label = 3 THEN -embedding[1] ELSE embedding[1] END, 6) AS x, CASE WHEN label = 3 THEN 2 ELSE 1 END AS version FROM embeddings WHERE label <> 4",
)
def vector_log(spark, d):
    """Vectors upserted into a log-structured table: one tenant's come again, another's are deleted, then segments are compacted."""
    log = Segments(new_folder(spark, "vectors"), ("tenant_id", "chunk_id"))
    v = table(spark, d, "embeddings").select(F.col("label").alias("tenant_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding")[0].alias("x"), F.lit(1).alias("version"))
    log.upsert("vectors", v)
    log.upsert("vectors", v.where("tenant_id = 3").withColumns({"x": -F.col("x"), "version": F.lit(2)}), deleted=v.where("tenant_id = 4"))
    log.compact(spark)
    return log.read(spark, "vectors").withColumn("x", F.round("x", 6))


@query("stream_job_progress", f"WITH {_EVENTS} SELECT job_id, arg_max(status, seq) AS status, max(pct) AS progress_pct, count(*) AS n_events FROM ev GROUP BY job_id")
def stream_job_progress(spark, d):
    target, mark = new_folder(spark, "progress"), new_folder(spark, "mark")
    stream_progress(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, target, mark, as_job_events).awaitTermination()
    return progress_table(spark, target)


@query(
    "embed_failures",
    "SELECT source, count(*) AS n, count(*) FILTER (contains(text, '@')) AS failed, CASE WHEN count(*) FILTER (contains(text, '@')) = 0 THEN 'complete' ELSE 'partial_success' END AS status, coalesce(max(CASE WHEN contains(text, '@') THEN 3 END), 0) AS most_attempts FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]') GROUP BY source",
)
def embed_failures(spark, d):
    """An encoder that refuses any batch with an address in it: only the texts that hold one are left out."""

    def picky(texts):
        if any("@" in t for t in texts):
            raise ValueError("address")
        return hashed_vectors(texts)

    done = embed_with_status(table(spark, d, "documents").where(F.col("text").rlike(r"[^ \t\n\r]")), picky)
    failed = F.col("embedding").isNull()
    attempts = F.coalesce(F.max(F.when(failed, F.col("embedding_status.attempts"))), F.lit(0))
    return done.groupBy("source").agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.when(F.bool_or(failed), "partial_success").otherwise("complete").alias("status"), attempts.alias("most_attempts"))


_KEYS = "k AS (SELECT *, md5(lower(trim(text))) AS key, conv_id * 100 + turn AS id FROM conversations WHERE text IS NOT NULL)"


@query(
    "query_vector_cache",
    f"""WITH {_KEYS}, {Q._vectors_sql("kv", "key", "(SELECT DISTINCT md5(lower(trim(text))) AS key, lower(trim(text)) AS text FROM conversations WHERE text IS NOT NULL)")},
one AS (SELECT key, min(id) AS place FROM k WHERE role = 'user' GROUP BY key), held AS (SELECT key FROM one ORDER BY place DESC, key LIMIT 500)
SELECT role, key, count(*) AS n, role <> 'user' AND key IN (SELECT key FROM held) AS hit, CASE WHEN regexp_matches(any_value(text), '[^ \t\n\r]') THEN md5(array_to_string(list_transform(coalesce(any_value(v), list_transform(range(64), lambda x: 0.0)), lambda x: CAST(x AS INT)), ',')) END AS digest
FROM k LEFT JOIN kv ON kv.id = key GROUP BY role, key""",
)
def query_vector_cache(spark, d):
    """Users' turns as a first batch of queries, the others as a second one: what the cache has, and the vectors."""
    cache = Segments(new_folder(spark, "query-vectors"), ("key",))
    turns = table(spark, d, "conversations").where("text is not null").select("role", "text", (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"))
    done = cached_vectors(turns.where("role = 'user'"), cache).unionByName(cached_vectors(turns.where("role <> 'user'"), cache))
    digest = F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("int")), ","))
    return done.groupBy("role", "key").agg(F.count("*").alias("n"), F.bool_or("hit").alias("hit"), F.max(digest).alias("digest"))


@query(
    "report_run",
    """SELECT 'metrics' AS report, lang AS name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang
UNION ALL SELECT 'failures', source, count(*), 0 FROM documents WHERE length(trim(text)) < 50 GROUP BY source
UNION ALL SELECT 'manifest', 'metrics', count(DISTINCT lang), 0 FROM documents
UNION ALL SELECT 'manifest', 'failures', count(DISTINCT source), 0 FROM documents WHERE length(trim(text)) < 50
UNION ALL SELECT 'manifest', 'summary', count(DISTINCT lang) + 4, 0 FROM documents""",
)
def report_run(spark, d):
    """A run's reports written and read back: sizes by language, texts too short to use, and the manifest."""
    docs, folder = table(spark, d, "documents"), new_folder(spark, "reports")
    metrics = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    failures = docs.where(F.length(F.trim("text")) < 50).groupBy("source").agg(F.count("*").alias("n"))
    write_run({"metrics": metrics, "failures": failures}, markdown_table(metrics, "Sizes", "lang"), folder, "1")
    of = lambda name: read_run(spark, folder, "1", name).withColumn("report", F.lit(name))
    out = of("metrics").select("report", F.col("lang").alias("name"), "n", "chars")
    out = out.unionByName(of("failures").select("report", F.col("source").alias("name"), "n", F.lit(0).cast("bigint").alias("chars")))
    return out.unionByName(read_run(spark, folder, "1", "manifest").select(F.lit("manifest").alias("report"), F.col("report").alias("name"), F.col("n_rows").alias("n"), F.lit(0).cast("bigint").alias("chars")))

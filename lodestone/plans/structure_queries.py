"""Registered queries over pages with tables and code: one HTML page of each order, with its lines and its record."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.html import markdown_with_structure
from lodestone.functions.text import token_estimate
from lodestone.operators import chunking as K
from lodestone.operators.cleaning import block_array
from lodestone.plans.common import query, sql_tokens, table


def order_pages(spark, d):
    """(doc_id, html): a heading, a paragraph, the lines as a table (from the fourth on in a second table without header), notes and a record in code."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("l_linenumber"), cell("l_partkey"), cell("l_returnflag"), F.lit("</tr>"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", row.alias("row"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias("rows"))
    head, rest = F.array_join(F.slice("rows", 1, 3), ""), F.slice("rows", 4, 10_000)
    more = F.when(F.size(rest) > 0, F.concat(F.lit("<table>"), F.array_join(rest, ""), F.lit("</table>"))).otherwise("")
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    html = F.concat(
        F.lit("<html><head><title>t</title><style>p{}</style></head><body><h1>Order "), "o_orderkey", F.lit("</h1><p>Status <b>"), "o_orderstatus", F.lit("</b> &amp; priority\n"), "o_orderpriority",
        F.lit('<h2>Lines</h2><table><tr><th>line</th><th>part</th><th>flag</th></tr>'), head, F.lit("</table>"), more,
        F.lit("<h2>Notes</h2><ul><li>customer "), "o_custkey", F.lit("<li>total "), F.floor("o_totalprice").cast("string"),
        F.lit('</ul><h3>Record</h3><pre><code class="language-json">{"order": '), "o_orderkey", F.lit(',\n\n  "customer": '), "o_custkey", F.lit("}</code></pre></body></html>"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), html.alias("html"))


# The blocks that the pages must give, written out by hand: (sec_idx, place, kind, path, content, merged).
_BLOCKS = """r AS (SELECT l_orderkey AS k, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' AS row, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
l AS (SELECT k, string_agg(row, chr(10) ORDER BY i) FILTER (i <= 3) AS head, string_agg(row, chr(10) ORDER BY i) FILTER (i > 3) AS rest, count(*) FILTER (i > 3) AS n FROM r GROUP BY k),
o AS (SELECT *, 'Order ' || o_orderkey AS t FROM orders JOIN l ON k = o_orderkey),
blocks AS (SELECT doc_id, sec_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec_idx, place) - 1 AS INT) AS idx, kind, path, content, merged FROM (
  SELECT o_orderkey AS doc_id, 1 AS sec_idx, 0 AS place, 'heading' AS kind, t AS path, '# ' || t AS content, 0 AS merged FROM o
  UNION ALL SELECT o_orderkey, 1, 1, 'text', t, 'Status **' || o_orderstatus || '** & priority ' || o_orderpriority, 0 FROM o
  UNION ALL SELECT o_orderkey, 2, 0, 'heading', t || ' > Lines', '## Lines', 0 FROM o
  UNION ALL SELECT o_orderkey, 2, 1, 'table', t || ' > Lines', concat_ws(chr(10), '| line | part | flag |', '| --- | --- | --- |', head, CASE WHEN n > 1 THEN rest END), CAST(n > 1 AS INT) FROM o
  UNION ALL SELECT o_orderkey, 2, 2, 'text', t || ' > Lines', rest, 0 FROM o WHERE n = 1
  UNION ALL SELECT o_orderkey, 3, 0, 'heading', t || ' > Notes', '## Notes', 0 FROM o
  UNION ALL SELECT o_orderkey, 3, 1, 'list', t || ' > Notes', '- customer ' || o_custkey || chr(10) || '- total ' || CAST(floor(o_totalprice) AS BIGINT), 0 FROM o
  UNION ALL SELECT o_orderkey, 4, 0, 'heading', t || ' > Notes > Record', '### Record', 0 FROM o
  UNION ALL SELECT o_orderkey, 4, 1, 'code', t || ' > Notes > Record', '```json' || chr(10) || '{"order": ' || o_orderkey || ',' || chr(10) || chr(10) || '  "customer": ' || o_custkey || '}' || chr(10) || '```', 0 FROM o))"""


def _order_markdown(spark, d):
    return order_pages(spark, d).select("doc_id", markdown_with_structure(F.col("html")).alias("markdown"))


@query("html_structure", f"WITH {_BLOCKS} SELECT doc_id, md5(string_agg(CASE WHEN merged = 1 THEN replace(content, chr(10) || rest, chr(10) || chr(10) || rest) ELSE content END, chr(10) || chr(10) ORDER BY idx)) AS digest FROM blocks JOIN l ON k = doc_id GROUP BY doc_id")
def html_structure(spark, d):
    """Markdown of the pages: five kinds of blocks, blank lines between them."""
    return _order_markdown(spark, d).select("doc_id", F.md5("markdown").alias("digest"))


@query("structured_sections", f"WITH {_BLOCKS} SELECT doc_id, CAST(sec_idx AS INT) AS sec_idx, idx, kind, path, md5(content) AS digest FROM blocks")
def structured_sections(spark, d):
    """All blocks of the pages: sections, kinds, heading paths and texts."""
    blocks = K.section_blocks(_order_markdown(spark, d))
    return blocks.select("doc_id", "sec_idx", "idx", "kind", F.array_join("heading_path", " > ").alias("path"), F.md5("content").alias("digest"))


@query("merge_orphan_tables", f"WITH {_BLOCKS} SELECT doc_id, idx, content, CAST(merged AS INT) AS n_merged FROM blocks WHERE kind = 'table'")
def merge_orphan_tables(spark, d):
    """The pages' tables; rows of a table without a header joined the one before."""
    return K.section_blocks(_order_markdown(spark, d)).where("kind = 'table'").select("doc_id", "idx", "content", "n_merged")


@query(
    "structured_chunks",
    f"""WITH {_BLOCKS}, c AS (SELECT doc_id, sec_idx, CAST(sum({sql_tokens('content')}) AS INT) AS tokens, string_agg(content, chr(10) || chr(10) ORDER BY idx) AS text, bool_or(kind = 'table') AS has_table, bool_or(kind = 'code') AS has_code FROM blocks GROUP BY doc_id, sec_idx)
SELECT doc_id, CAST(sec_idx AS INT) AS sec_idx, tokens, CASE WHEN has_table OR has_code THEN 'mixed' ELSE 'text' END AS content_type, CASE WHEN has_code THEN 'json' ELSE '' END AS languages, md5(text) AS digest FROM c""",
)
def structured_chunks(spark, d):
    """The pages' sections as chunks: tables and code stay whole, beside their headings."""
    packed = K.pack_sections(K.section_rows(_order_markdown(spark, d), block_array(F.col("markdown"))))
    return packed.select("doc_id", "sec_idx", "tokens", "content_type", F.array_join("code_languages", ",").alias("languages"), F.md5("text").alias("digest"))


@query("section_tokens", f"WITH {_BLOCKS} SELECT doc_id, kind, CAST(sum({sql_tokens('content')}) AS BIGINT) AS tokens, count(*) AS n FROM blocks GROUP BY doc_id, kind")
def section_tokens(spark, d):
    """Tokens of each kind of block of the pages."""
    blocks = K.section_blocks(_order_markdown(spark, d))
    return blocks.groupBy("doc_id", "kind").agg(F.sum(token_estimate(F.col("content"))).alias("tokens"), F.count("*").alias("n"))

"""Structure-aware chunking: sections with heading paths, token-bounded packing with overlap, small-chunk merges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.operators.cleaning import block_array


@dataclass(frozen=True)
class ChunkingConfig:
    """Sizes in tokens."""

    size: int = 600
    overlap: int = 125
    hard_limit: int = 2_000
    least: int = 150
    most: int = 800
    tiny: int = 40


DEFAULT = ChunkingConfig()


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))


def chunk_block_type(content: Column) -> Column:
    """code, heading, table (a pipe row and a separator row), list or text."""
    return _kind(content, F.transform(F.split(content, "\n"), lambda x: F.trim(x)))


def _kind(content: Column, lines: Column) -> Column:
    table = F.exists(lines, is_pipe_row) & F.exists(lines, lambda x: x.rlike(r"^\|[-| :]+\|$"))
    return F.when(content.startswith("```"), "code").when(content.startswith("#"), "heading").when(table, "table").when(content.rlike(r"^(?:[-*] |\d+\.\s)"), "list").otherwise("text")


def is_pipe_row(line: Column) -> Column:
    return line.startswith("|") & line.endswith("|")


def _typed(blocks: Column) -> Column:
    """What the fold looks at: a block's kind, heading and columns, and whether it is rows of a table without their header.

    One step after the other, so that lines and kinds are found once.
    """
    lined = F.transform(blocks, lambda b: F.struct(b.alias("content"), F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines")))
    kinds = F.transform(lined, lambda b: F.struct(b["content"].alias("content"), b["lines"].alias("lines"), F.filter(b["lines"], is_pipe_row).alias("rows"), _kind(b["content"], b["lines"]).alias("kind")))

    def seen(b: Column) -> Column:
        content, kind, lines, rows = b["content"], b["kind"], b["lines"], b["rows"]
        orphan = ~kind.isin("code", "heading", "table") & (F.size(rows) >= 2) & (F.size(rows) * 5 >= F.size(lines) * 4)
        columns = F.regexp_count(F.when(kind == "table", F.get(lines, F.lit(0))).otherwise(F.get(rows, F.lit(0))), F.lit(r"\|"))
        level = F.when(kind == "heading", heading_level(content)).otherwise(0)
        title = F.when(level > 0, F.trim(F.regexp_replace(content, r"^#{1,6}\s+|\s*#+$", ""))).otherwise("")
        return F.struct(content.alias("content"), kind.alias("kind"), level.alias("level"), title.alias("title"), F.coalesce(columns, F.lit(0)).alias("columns"), orphan.alias("orphan"))

    return F.transform(kinds, seen)


#: Sections as the fold gives them: which blocks of the document each block is made of, from the ``first`` on.
FOLDED = "array<struct<sec_idx: int, blocks: array<struct<idx: int, first: int, n: int, heading_path: array<string>, char_start: bigint>>>>"


def _listed(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of so many values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes of lists (null: 0), and their values."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def fold_blocks(level: pa.Array, title: pa.Array, columns: pa.Array, table: pa.Array, orphan: pa.Array, length: pa.Array) -> pa.Array:
    """Sections of documents (``FOLDED``); each argument has a list for each document, a value for each block in order.

    A heading of level L starts a section and closes all open headings of L and deeper. Pipe rows of as many columns as
    the table before them in their section join it. All documents of a batch are folded at once.
    """
    sizes, levels = _flat(level)
    titles = _flat(title)[1]
    level, columns, table, orphan, length = (x.to_numpy(zero_copy_only=False) for x in (levels, *(_flat(x)[1] for x in (columns, table, orphan, length))))
    n, at = int(sizes.sum()), np.arange(int(sizes.sum()))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begins = (np.cumsum(sizes) - sizes)[doc]  # where the document's blocks begin
    last = lambda mask: np.maximum.accumulate(np.where(mask, at, -1)) if n else at

    heads = level > 0
    count = np.cumsum(heads)
    sec = count - (count - heads)[begins] if n else at
    # Rows join the block before them that isn't rows, if it is a table and all rows between were joined.
    base = last(~orphan)
    held = orphan & (base >= begins) & table[base] & (columns[base] == columns)
    merged = held & (last(orphan & ~held) < base)
    kept = ~merged
    idx = np.cumsum(kept) - 1
    first = np.flatnonzero(kept)
    many = np.diff(np.append(first, n))
    idx = idx[first] - idx[begins[first]]
    chars = np.cumsum(length + 2) - (length + 2)
    chars = chars[first] - chars[begins[first]]

    # A heading is open unless one of its level or above came later.
    where, above = np.full((6, n), -1), begins - 1
    for k in range(6):
        mine = last(level == k + 1)
        where[k] = np.where(mine > above, mine, -1)
        above = np.maximum(above, mine)
    where = where[:, first].T
    paths = _listed((where >= 0).sum(axis=1), titles.take(pa.array(where[where >= 0])))

    blocks = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(first - begins[first], pa.int32()), pa.array(many, pa.int32()), paths, pa.array(chars, pa.int64())], ["idx", "first", "n", "heading_path", "char_start"])
    doc, sec = doc[first], sec[first]
    starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (sec[1:] != sec[:-1]))[: len(doc)])
    sections = pa.StructArray.from_arrays([pa.array(sec[starts], pa.int32()), _listed(np.diff(np.append(starts, len(doc))), blocks)], ["sec_idx", "blocks"])
    return _listed(np.bincount(doc[starts], minlength=len(sizes)), sections)


def with_sections(rows: DataFrame, blocks: Column) -> DataFrame:
    """``rows`` with ``sections`` of an array of block texts: one fold in the document's row, without a shuffle or a sort.

    They are best unfolded by ``explode_outer``: for ``explode`` the optimizer adds a filter on their number, in which the fold runs again.

    sections: array of (sec_idx, blocks: array of (idx, content, kind, level, heading_path, char_start, n_merged)).
    Texts stay where they are; the fold gets their lengths.
    """
    fold = F.arrow_udf(fold_blocks, FOLDED)
    # A generator of one row, since the optimizer would put a plain column's expression in each of its uses.
    typed = rows.select("*", F.explode(F.array(_typed(blocks))).alias("__typed"))
    of = lambda f: F.transform("__typed", f)
    folded = fold(of(lambda b: b["level"]), of(lambda b: b["title"]), of(lambda b: b["columns"]), of(lambda b: b["kind"] == "table"), of(lambda b: b["orphan"]), of(lambda b: F.length(b["content"])))

    def whole(b: Column) -> Column:
        own = F.get(F.col("__typed"), b["first"])
        joined = F.array_join(F.transform(F.slice("__typed", b["first"] + 1, b["n"]), lambda x: x["content"]), "\n")
        content = F.when(b["n"] == 1, own["content"]).otherwise(joined)
        return F.struct(b["idx"].alias("idx"), content.alias("content"), own["kind"].alias("kind"), own["level"].alias("level"), b["heading_path"].alias("heading_path"), b["char_start"].alias("char_start"), (b["n"] - 1).alias("n_merged"))

    found = F.transform("__folded", lambda s: F.struct(s["sec_idx"].alias("sec_idx"), F.transform(s["blocks"], whole).alias("blocks")))
    return typed.withColumn("__folded", folded).withColumn("sections", found).drop("__typed", "__folded")


def section_blocks(docs: DataFrame, doc: str = "doc_id", markdown: str = "markdown", split: bool = False) -> DataFrame:
    """(doc, sec_idx, idx, content, kind, level, heading_path, char_start, n_merged): blocks with their section.

    With ``split``, text blocks over 5,000 characters are cut first.
    """
    blocks = block_array(F.col(markdown))
    sections = with_sections(docs.select(doc, markdown), cut_blocks(blocks) if split else blocks).select(doc, F.explode_outer("sections").alias("s")).where("s is not null")
    return sections.select(doc, "s.sec_idx", F.explode("s.blocks").alias("b")).select(doc, "sec_idx", "b.*")


def section_rows(docs: DataFrame, blocks: Column, tokens: Callable[[Column], Column] = token_estimate, doc: str = "doc_id") -> DataFrame:
    """(doc, sec_idx, b): each section's blocks in order with their tokens, as ``pack_sections`` takes them."""
    sections = with_sections(docs, blocks).select(doc, F.explode_outer("sections").alias("s")).where("s is not null")
    block = lambda b: F.struct(b["idx"].alias("idx"), b["content"].alias("content"), b["kind"].alias("kind"), tokens(b["content"]).alias("tokens"), b["heading_path"].alias("heading_path"), b["char_start"].alias("char_start"))
    return sections.select(doc, "s.sec_idx", F.transform("s.blocks", block).alias("b"))


def with_tokens(blocks: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Token counts (a column provider; the default is the estimate) and the place of each block in characters."""
    counted = blocks.withColumn("tokens", token_estimate(F.col("content")) if tokens is None else tokens)
    if "char_start" in blocks.columns:
        return counted
    before = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("char_start", F.coalesce(F.sum(F.length("content") + 2).over(before), F.lit(0)))


def pack_ranges(tokens: list[int], structured: list[bool], config: ChunkingConfig = DEFAULT) -> list[tuple[int, int, int]]:
    """(first, last, tokens) of chunks of one section's blocks.

    A block that would pass ``size`` closes the chunk, whose last text blocks of up to ``overlap`` tokens are
    carried over; code and tables may ride up to ``most``, and past it start afresh without overlap.
    """
    out, first, total = [], 0, 0
    for i, n in enumerate(tokens):
        if i > first and total + n > config.size and not (structured[i] and total + n <= config.most):
            out.append((first, i - 1, total))
            start, carried = i, 0
            if not structured[i]:
                while start > first and not structured[start - 1] and carried + tokens[start - 1] <= config.overlap:
                    start -= 1
                    carried += tokens[start]
            first, total = start, carried
        total += n
    if tokens:
        out.append((first, len(tokens) - 1, total))
    return out


def pack(blocks: DataFrame, config: ChunkingConfig = DEFAULT, keys: tuple[str, ...] = ("doc_id", "sec_idx")) -> DataFrame:
    """(keys, chunk_in_section, first, last, tokens, n_blocks, text, content_type, heading_path, char_start, char_end).

    One row a section is gathered (a section is part of one document) and its greedy fold runs in an Arrow batch.
    """

    row = F.struct("idx", "content", "kind", "tokens", "heading_path", "char_start")
    return pack_sections(blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("b")), config, keys)


def pack_sections(sections: DataFrame, config: ChunkingConfig = DEFAULT, keys: tuple[str, ...] = ("doc_id", "sec_idx")) -> DataFrame:
    """As ``pack``, of rows that hold a section's blocks in order: (keys, b)."""

    @F.arrow_udf("array<struct<first: int, last: int, tokens: int>>")
    def ranges(tokens: pa.Array, structured: pa.Array) -> pa.Array:
        sizes, own = _flat(tokens)
        flat, kinds, ends = own.to_numpy(zero_copy_only=False).astype(np.int64), _flat(structured)[1].to_numpy(zero_copy_only=False), np.cumsum(sizes)
        sums = np.append(0, np.cumsum(flat))
        total = sums[ends] - sums[ends - sizes]
        # Most sections fit one chunk; only the others are folded.
        counts = np.where(sizes > 0, 1, 0)
        large = {}
        for i in np.flatnonzero(total > config.size):
            at = slice(ends[i] - sizes[i], ends[i])
            large[i] = pack_ranges(flat[at].tolist(), kinds[at].tolist(), config)
            counts[i] = len(large[i])
        rows = np.zeros((counts.sum(), 3), dtype=np.int64)
        starts = np.cumsum(counts) - counts
        one = np.flatnonzero(counts == 1)
        rows[starts[one], 1], rows[starts[one], 2] = sizes[one] - 1, total[one]
        for i, found in large.items():
            rows[starts[i] : starts[i] + len(found)] = found
        return _listed(counts, pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int32()) for k in range(3)], ["first", "last", "tokens"]))

    sections = sections.withColumn("r", ranges(F.transform("b", lambda x: x["tokens"]), F.transform("b", lambda x: x["kind"].isin("code", "table"))))
    chunks = sections.select(*keys, "b", F.posexplode_outer("r").alias("chunk_in_section", "r")).where("r is not null")
    own = F.slice("b", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1)
    chunks = chunks.withColumn("own", own).drop("b")
    kinds = F.array_distinct(F.transform("own", lambda x: F.when(x["kind"].isin("code", "table"), x["kind"]).otherwise("text")))
    last = F.element_at("own", -1)
    languages = F.array_distinct(F.filter(F.transform("own", lambda x: F.regexp_extract(x["content"], r"^```([A-Za-z0-9_+-]+)", 1)), lambda x: x != ""))
    return chunks.select(
        *keys,
        "chunk_in_section",
        F.col("r.first").alias("first"),
        F.col("r.last").alias("last"),
        F.col("r.tokens").alias("tokens"),
        F.size("own").alias("n_blocks"),
        F.array_join(F.transform("own", lambda x: x["content"]), "\n\n").alias("text"),
        F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed").alias("content_type"),
        languages.alias("code_languages"),
        F.col("own")[0]["heading_path"].alias("heading_path"),
        (F.col("own")[0]["kind"] == "heading").alias("starts_with_heading"),
        F.col("own")[0]["char_start"].alias("char_start"),
        (last["char_start"] + F.length(last["content"])).alias("char_end"),
        (F.col("r.tokens") > config.most).alias("oversized"),
    )


def should_merge(a: dict, b: dict, config: ChunkingConfig = DEFAULT) -> bool:
    """Whether the next chunk ``b`` of a document joins ``a``, whose lines with text are counted in ``lines`` or in its ``text``."""
    p, q = list(a["heading_path"]), list(b["heading_path"])
    related = not p or not q or p == q or (len(p) < len(q) and q[: len(p)] == p) or (len(p) == len(q) and p[:-1] == q[:-1])
    if not related or (a["content_type"] == b["content_type"] and a["content_type"] in ("code", "table")):
        return False
    tiny, fits = a["tokens"] < config.tiny, a["tokens"] + b["tokens"] <= config.most
    if a["starts_with_heading"] and tiny and (a["lines"] if "lines" in a else sum(1 for line in a["text"].split("\n") if line.strip())) <= 2:
        return True
    small = [x["tokens"] < config.least for x in (a, b)]
    return fits and (tiny or (all(small) if not p and not q else any(small)))


def merge_tiny(chunks: DataFrame, config: ChunkingConfig = DEFAULT, doc: str = "doc_id") -> DataFrame:
    """Chunks of each document with small ones merged into the next: a left fold over a document's chunks in order.

    Flags are computed anew after a merge. ``chunk_index`` and ``total_chunks`` count what is left. The fold gets no
    texts, only how many lines they have; what it merges is joined where the texts are.
    """
    row = F.struct(F.col("sec_idx").cast("int").alias("sec_idx"), "chunk_in_section", "text", "tokens", "content_type", "heading_path", "starts_with_heading", "char_start", "char_end")
    gathered = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(row)).alias("c"))
    lines = lambda x: F.size(F.filter(F.split(x["text"], "\n"), lambda s: ~s.rlike(r"(?U)^[\s\x1c-\x1f]*$")))
    seen = F.transform("c", lambda x: F.struct(*[x[n].alias(n) for n in ("tokens", "content_type", "heading_path", "starts_with_heading")], lines(x).alias("lines")))

    @F.arrow_udf("array<struct<first: int, n: int, tokens: int, content_type: string, heading_path: array<string>>>")
    def merged(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("tokens", pa.int32()), ("content_type", pa.string()), ("heading_path", pa.list_(pa.string()))]))
        return pa.array([merge_ranges(own.as_py() or [], config) for own in batch], kind)

    kept = gathered.withColumn("__kept", merged(seen)).select(doc, "c", F.size("__kept").alias("total_chunks"), F.posexplode_outer("__kept").alias("chunk_index", "m")).where("m is not null")
    kept = kept.withColumn("own", F.slice("c", F.col("m.first") + 1, F.col("m.n"))).drop("c")
    return kept.select(
        doc,
        "chunk_index",
        "total_chunks",
        F.array_join(F.transform("own", lambda x: x["text"]), "\n\n").alias("text"),
        F.col("m.tokens").alias("tokens"),
        F.col("m.content_type").alias("content_type"),
        F.col("m.heading_path").alias("heading_path"),
        F.col("own")[0]["starts_with_heading"].alias("starts_with_heading"),
        F.col("own")[0]["char_start"].alias("char_start"),
        F.element_at("own", -1)["char_end"].alias("char_end"),
        (F.col("m.tokens") > config.most).alias("oversized"),
        (F.col("m.n") > 1).alias("tiny_merged"),
    )


def merge_ranges(chunks: list[dict], config: ChunkingConfig = DEFAULT) -> list[dict]:
    """(first, n, tokens, content_type, heading_path) of what a document's chunks become."""
    kept: list[dict] = []
    for at, x in enumerate(chunks):
        c = x | {"first": at, "n": 1}
        if kept and should_merge(kept[-1], c, config):
            a = kept[-1]
            heading_only = a["starts_with_heading"] and a["tokens"] < config.tiny and len(c["heading_path"]) > len(a["heading_path"])
            a |= {"n": a["n"] + 1, "tokens": a["tokens"] + c["tokens"], "lines": a["lines"] + c["lines"]}
            a["content_type"] = a["content_type"] if a["content_type"] == c["content_type"] else "mixed"
            a["heading_path"] = c["heading_path"] if heading_only else a["heading_path"]
        else:
            kept.append(c)
    return [{k: c[k] for k in ("first", "n", "tokens", "content_type", "heading_path")} for c in kept]


def truncated(text: Column, tokens: Column, config: ChunkingConfig = DEFAULT) -> tuple[Column, Column]:
    """(text, tokens): over the hard limit the first limit / 1.3 words and a mark."""
    words = int(config.hard_limit / 1.3)
    cut = F.concat(F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, words), " "), F.lit(" [TRUNCATED]"))
    over = tokens > config.hard_limit
    return F.when(over, cut).otherwise(text), F.when(over, config.hard_limit).otherwise(tokens)


def chunk_id(url: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%03d", F.md5(url), index)


def embedding_text(title: Column, path: Column, text: Column, prepared: Column | None = None) -> Column:
    """The text under a line with the title and the heading path; for chunks that were prepared, what that made."""
    head = F.concat(F.lit("["), F.concat_ws(" > ", title, F.array_join(path, " > ")), F.lit("]\n"), text)
    if prepared is None:
        return head
    section = F.when(F.size(path) > 0, F.concat(F.lit(" | Section: "), F.array_join(path, " > "))).otherwise("")
    return F.coalesce(F.nullif(prepared, F.lit("")), F.concat(F.lit("Document: "), title, section, F.lit("\n\n"), text))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\x02"), "\x02"), lambda s: F.trim(s) != "")


def sentence_groups(parts: Column, most: int = 4_000, joint: str = " ") -> Column:
    """Sentences (or lines) packed greedily into pieces of at most ``most`` characters, unless one alone is longer."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, s: Column) -> Column:
        fits = (state["now"] == "") | (F.length(state["now"]) + 1 + F.length(s) <= most)
        longer = F.when(state["now"] == "", s).otherwise(F.concat(state["now"], F.lit(joint), s))
        return F.when(fits, F.struct(state["done"].alias("done"), longer.alias("now"))).otherwise(F.struct(F.array_append(state["done"], state["now"]).alias("done"), s.alias("now")))

    return F.aggregate(parts, start, add, lambda state: F.when(state["now"] == "", state["done"]).otherwise(F.array_append(state["done"], state["now"])))


def _pieces(content: Column, lines: int, most: int) -> Column:
    packed = sentence_groups(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""), lines, "\n")
    return F.flatten(F.transform(packed, lambda p: F.when(F.length(p) > most, sentence_groups(sentences(p), most)).otherwise(F.array(p))))


def cut_blocks(blocks: Column, over: int = 5_000, lines: int = 3_000, most: int = 4_000) -> Column:
    """An array of block texts with those of ``split_oversize`` cut, in the row."""
    large = lambda b: (F.length(b) > over) & ~chunk_block_type(b).isin("code", "heading")
    return F.flatten(F.transform(blocks, lambda b: F.when(large(b), _pieces(b, lines, most)).otherwise(F.array(b))))


def split_oversize(blocks: DataFrame, over: int = 5_000, lines: int = 3_000, most: int = 4_000, doc: str = "doc_id") -> DataFrame:
    """``blocks`` with text of more than ``over`` characters cut: lines packed to ``lines`` characters, and pieces still over ``most`` by sentences.

    Blocks are numbered anew within the document.
    """
    pieces = _pieces(F.col("content"), lines, most)
    large = (F.length("content") > over) & ~F.col("kind").isin("code", "heading")
    cut = blocks.select("*", F.posexplode(F.when(large, pieces).otherwise(F.array("content"))).alias("__part", "__piece"))
    idx = F.row_number().over(W.partitionBy(doc).orderBy("idx", "__part")) - 1
    return cut.withColumn("idx", idx).withColumn("content", F.col("__piece")).drop("__part", "__piece")


def merge_orphan_tables(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, run, content, n_blocks) of block rows (doc, idx, content): pipe rows of as many columns as the table before them join it.

    A table has a separator row. Rows are two or more and make up four fifths of the block's lines with text.
    """
    own = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("b"))
    sections = with_sections(own, F.transform("b", lambda x: x["content"])).select(doc, F.explode_outer("sections").alias("s")).where("s is not null")
    rows = sections.select(doc, F.explode("s.blocks").alias("b"))
    return rows.select(doc, (F.col("b.idx") + 1).cast("bigint").alias("run"), "b.content", (F.col("b.n_merged") + 1).cast("bigint").alias("n_blocks"))


def chunk_documents(docs: DataFrame, config: ChunkingConfig = DEFAULT, doc: str = "doc_id", markdown: str = "markdown", tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Documents to merged chunks. ``tokens``: a column provider of token counts.

    Sections are made and packed in the document's row; only a document's chunks are shuffled, to be merged.
    """
    sections = section_rows(docs.select(F.col(doc).alias("doc_id"), markdown), cut_blocks(block_array(F.col(markdown))), tokens)
    return merge_tiny(pack_sections(sections, config), config)

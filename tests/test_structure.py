"""Markdown with structure, and the fold of a document's blocks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions.html import markdown_with_structure, structured_markdown
from lodestone.operators import chunking as K

TABLE = "<table><thead><tr><th>a<th>b|c</tr></thead><tr><td>1</td><td>two<br>lines</td></tr><tr><td><b>x</b></table>"


@pytest.mark.parametrize(
    "html,markdown",
    [
        ("<h1>One</h1><p>a &amp; b<p>c", "# One\n\na & b\n\nc"),
        ("<p><b>bold <a href='/x'>link</b> rest", "**bold [link](/x)** rest"),
        ("<b>never closed<p>next", "**never closed**\n\nnext"),
        ("a<b> b </b>c", "a **b** c"),
        (TABLE, "| a | b\\|c |\n| --- | --- |\n| 1 | two lines |\n| **x** |  |"),
        ("<table><tr><td>1<td>2</table><p>t", "| 1 | 2 |\n\nt"),
        ("<table><tr><th>k</th><td><table><tr><td>in</td></tr></table></td></tr></table>", "| k | in |\n| --- | --- |"),
        ("<pre><code class='language-py'>x = 1\n\n  y &lt; 2</code></pre>after", "```py\nx = 1\n\n  y < 2\n```\n\nafter"),
        ("<pre>open", "```\nopen\n```"),
        ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>e", "- a\n- b\n1. c\n2. d\n\ne"),
        ("use <code>f(x)</code>.", "use `f(x)`."),
        ("<head><title>t</title></head><script>if (a<b) {}</script><style>p{}</style><body>x<br/>y</body>", "x\ny"),
        ("<h2>two\nlines</h2><unknown>z</unknown>", "## two lines\n\nz"),
        ("", ""), (None, None), ("<p> <b> </b></p>", ""), ("<table><tr></tr></table>", ""), ("</table></td>x", "x"),
    ],
)
def test_markdown_of_pages(html, markdown):
    assert structured_markdown(html) == markdown


def test_long_and_repeated_pages(spark):
    html = "<p>" + "word " * 50_000 + TABLE * 500
    rows = spark.createDataFrame([(html,), (html,), (None,)], "html string").select(markdown_with_structure(F.col("html")).alias("m")).collect()
    assert rows[0] == rows[1] and rows[2]["m"] is None and rows[0]["m"].count("| --- | --- |") == 500


MD = """intro

# A

| a | b |
| --- | :-- |
| 1 | 2 |

| 3 | 4 |
| 5 | 6 |

| 7 | 8 |

| x | y | z |
| x | y | z |

## B

| 9 | 10 |
| 11 | 12 |

```py
| 1 | 2 |
| 3 | 4 |
```

- item
- item

### C #

# D"""


def folded(spark, md, **options):
    rows = K.section_blocks(spark.createDataFrame([(1, md)], "doc_id int, markdown string"), **options).orderBy("idx").collect()
    return [(r["sec_idx"], r["kind"], "/".join(r["heading_path"]), r["n_merged"]) for r in rows], rows


def test_sections_tables_and_code(spark):
    got, rows = folded(spark, MD)
    assert got == [
        (0, "text", "", 0), (1, "heading", "A", 0), (1, "table", "A", 1), (1, "text", "A", 0), (1, "text", "A", 0), (2, "heading", "A/B", 0),
        (2, "text", "A/B", 0), (2, "code", "A/B", 0), (2, "list", "A/B", 0), (3, "heading", "A/B/C", 0), (4, "heading", "D", 0),
    ]
    assert rows[2]["content"].endswith("| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |")
    assert [r["char_start"] for r in rows][:3] == [0, 7, 12]


def test_rows_join_only_a_table_of_as_many_columns(spark):
    rows = [(1, 0, "|a|b|\n|1|2|"), (1, 1, "|3|4|\n|5|6|"), (2, 0, "|a|b|\n|---|---|"), (2, 1, "|1|2|\n\n|3|4|\nx"), (2, 2, "|1|2|\n \n|3|4|\n|5|6|\n|7|8|\nx"), (2, 3, "|1|2|3|\n|4|5|6|")]
    got = K.merge_orphan_tables(spark.createDataFrame(rows, "doc_id int, idx int, content string")).orderBy("doc_id", "run").collect()
    assert [(r["doc_id"], r["n_blocks"]) for r in got] == [(1, 1), (1, 1), (2, 1), (2, 1), (2, 1), (2, 1)]
    assert got[0]["content"] == "|a|b|\n|1|2|"


def test_chunks_keep_tables_and_code_whole(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {k} | some words here |" for k in range(60))
    md = "# T\n\n" + "lead " * 380 + "\n\n" + table + "\n\n" + "| 1 | 2 |\n" * 60 + "\n```sql\n" + "select 1 from t;\n" * 150 + "```\n\nend"
    rows = K.chunk_documents(spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id int, markdown string")).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {1}
    held = [r for r in rows if "| 59 | some words here |\n| 1 | 2 |" in r["text"]]
    assert len(held) == 1 and held[0]["text"].count("| --- | --- |") == 1
    assert any(r["text"].count("```") == 2 and r["content_type"] in ("code", "mixed") for r in rows)
    assert all(r["heading_path"] == ["T"] for r in rows)


def test_long_blocks_are_cut_in_the_row(spark):
    line = "A sentence of some words. " * 60
    got, rows = folded(spark, "short\n\n" + "\n".join([line] * 4) + "\n\n```\n" + "x" * 6_000 + "\n```", split=True)
    assert [k for _, k, _, _ in got][0] == "text" and got[-1][1] == "code" and len(got) > 3
    assert all(len(r["content"]) <= 4_000 for r in rows if r["kind"] == "text") and len(rows[-1]["content"]) > 6_000


def test_plain_pages_are_split_at_their_tags(monkeypatch):
    """Pages of plain tags don't go through the parser, and give what it gives; the others do."""
    rng, plain, read = random.Random(3), 0, H._Writer.feed
    fed: list[str] = []
    monkeypatch.setattr(H._Writer, "feed", lambda self, html: (fed.append(html), read(self, html))[1])
    names = ["p", "h2", "table", "tr", "td", "th", "b", "code", "a", "pre", "ul", "ol", "li", "br", "hr", "style", "title", "textarea", "span", "noscript"]
    for _ in range(4_000):
        bits = []
        for _ in range(rng.randint(1, 20)):
            n = rng.choice(names)
            tag = [f"<{n}>", f"<{n} class='language-py'>", f'<{n} href="/x&amp;y">', f"<{n}/>", f"</{n}>", f"</{n}>", f"</{n}>", "<!-- <b> -->", "a < b"]
            bits.append(rng.choices(tag, [9, 1, 1, 1, 3, 3, 3, 0.1, 0.1])[0] + rng.choice(["", "x", " a\nb ", "&lt;p|"]))
        html = rng.choice(["", "<table>"]) + "".join(bits)
        before = len(fed)
        got = structured_markdown(html)
        plain += len(fed) == before
        whole = H._Writer()
        read(whole, html)
        whole.close()
        assert got == whole.markdown(), html
    assert 400 < plain < 4_000
    fed.clear()
    structured_markdown("<h1>t</h1>" + TABLE)
    assert not fed


def one_by_one(blocks):
    """The fold of one document, block by block: (sec_idx, [(idx, first, n, path, char_start)])."""
    out, stack, columns, kind, at, idx = [(0, [])], [], -1, "", 0, 0
    for i, (level, title, cols, table, orphan, length) in enumerate(blocks):
        if level:
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            out.append((len(out), []))
        own = out[-1][1]
        if orphan and own and kind == "table" and columns == cols:
            own[-1][2] += 1
        else:
            own.append([idx, i, 1, [x[1] for x in stack], at])
            columns, kind, idx = cols, "table" if table else "", idx + 1
        at += length + 2
    return [s for s in out if s[1]]


def test_documents_are_folded_together_as_one_by_one():
    rng = random.Random(4)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(0, 5)):
            own = []
            for _ in range(rng.randint(0, 12)):
                what = rng.choice(["head", "table", "rows", "rows", "text"])
                own.append((rng.randint(1, 6) if what == "head" else 0, f"t{rng.random():.3f}" if what == "head" else "", rng.choice([2, 3]), what == "table", what == "rows", rng.randint(0, 9)))
            docs.append(own if own or rng.random() < 0.5 else None)
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32()]
        columns = [pa.array([None if d is None else [b[k] for b in d] for d in docs], pa.list_(kind)) for k, kind in enumerate(kinds)]
        got = K.fold_blocks(*columns).to_pylist()
        assert [[(s["sec_idx"], [list(b.values()) for b in s["blocks"]]) for s in d] for d in got] == [one_by_one(d or []) for d in docs]


def test_chunks_are_merged_without_their_texts(spark):
    """The fold of chunks gets no texts, only how many lines they have; texts are joined behind it."""
    head = {"tokens": 3, "content_type": "text", "heading_path": ["A"], "starts_with_heading": True, "lines": 1}
    body = {"tokens": 790, "content_type": "table", "heading_path": ["A", "B"], "starts_with_heading": False, "lines": 90}
    assert K.merge_ranges([head, body, body]) == [
        {"first": 0, "n": 2, "tokens": 793, "content_type": "mixed", "heading_path": ["A", "B"]},
        {"first": 2, "n": 1, "tokens": 790, "content_type": "table", "heading_path": ["A", "B"]},
    ]
    md = "# A\n\n" + "\n\n".join("word " * 400 for _ in range(40)) + "\n\n## B\n\nshort"
    got = K.chunk_documents(spark.createDataFrame([(1, md), (2, "x")], "doc_id int, markdown string")).orderBy("doc_id", "chunk_index").collect()
    assert got[-1]["text"] == "x" and got[-2]["text"].endswith("## B\n\nshort") and sum(r["text"].count("word") for r in got) >= 16_000

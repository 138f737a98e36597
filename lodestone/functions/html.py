"""Markdown from HTML that keeps its structure: headings, lists, tables, code, bold text and links.

One pass over the tags of a page with a stack of what is open. Tables become pipe tables, with a separator row behind a
header row and none without one; ``pre`` becomes a fence, ``b`` and ``strong`` stars. A tag that closes an outer element
closes what is open in it; what a page never closes ends with its block.

Pages whose markup is all plain tags are split at them, and each distinct tag is parsed once; others go through the
parser whole, with the same result.

Defined results: null stays null; a page without text gives the empty text; unknown tags are read through; scripts,
styles and heads are skipped; pipes within cells are escaped; tables within cells become text.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "head", "noscript", "template"}
BLOCKS = {"p", "div", "section", "article", "nav", "main", "header", "footer", "aside", "body", "html", "ul", "ol", "dl", "dt", "dd", "figure", "figcaption", "blockquote", "form", "hr", "address"}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
MARKS = {"b": "**", "strong": "**", "code": "`"}
_SPACE, _BLANK = re.compile(r"\s+"), re.compile(r"[^\S\n]+")

#: Tags that the parser reads alike wherever they stand: no stray quotes or slashes.
_TAG = re.compile(r"(<[^<>]*>)")
_PLAIN = re.compile(r"""</?[A-Za-z][A-Za-z0-9]*(?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9:-]*(?:="[^"<>]*"|='[^'<>]*')?)*[ \t\n\r\f]*/?>""")
#: Elements whose text the parser reads in a mode of its own: it is the same where that text holds no tag.
_RAW = {"script", "style", "title", "textarea"}
_OPAQUE = {"xmp", "iframe", "noembed", "noframes", "plaintext", "noscript"}
START, END, EMPTY, RAW, OTHER = range(5)
_OTHER = (OTHER, "", {})  # of a tag that isn't plain
#: Distinct tags that a worker remembers; links make many.
MOST_TAGS = 20_000
_known: dict[str, tuple[int, str, dict]] = {}


class _Reader(HTMLParser):
    """Notes what the parser makes of one tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, dict]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append((START, tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((END, tag, {}))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.found.append((EMPTY, tag, dict(attrs)))


def _read_tag(tag: str) -> tuple[int, str, dict]:
    """(kind, name, attributes) of a plain tag."""
    out = _OTHER
    if _PLAIN.fullmatch(tag):
        reader = _Reader()
        reader.feed(tag)
        if len(reader.found) == 1 and reader.found[0][1] not in _OPAQUE:
            kind, name, own = reader.found[0]
            out = (RAW if kind == START and name in _RAW else kind, name, own)
    if len(_known) >= MOST_TAGS:
        _known.clear()
    _known[tag] = out
    return out


def _plain_tags(parts: list[str]) -> list[tuple[int, str, dict]] | None:
    """The tags of a page split at them (the odd parts), if all are plain."""
    tags = list(map(_known.get, parts[1::2]))
    if None in tags:
        tags = [_known.get(tag) or _read_tag(tag) for tag in parts[1::2]]
    for i, t in enumerate(tags):
        if t[0] >= RAW and (t is _OTHER or i + 1 == len(tags) or tags[i + 1][:2] != (END, t[1])):
            return None
    return tags


class _Writer(HTMLParser):
    """Collects blocks (kind, text); inline text gathers in ``line`` until its block ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.line: list[str] = []
        self.marks: list[tuple[str, int, str]] = []  # (tag, where its text starts in the line, link)
        self.kind = "text"  # of the block that the line will be
        self.skipped: list[str] = []
        self.lists: list[int | None] = []  # the next number of an ordered list, none of a plain one
        self.fence: list[str] | None = None  # text of an open pre
        self.language = ""
        self.tables = 0
        self.rows: list[list[str]] = []
        self.header = False  # whether the table's first row is one
        self.cell = False

    # -- inline text --------------------------------------------------------------------------------------------
    def close_mark(self, tag: str) -> None:
        """Wraps the text since the last open ``tag``; marks opened after it end too."""
        while any(m[0] == tag for m in self.marks):
            name, start, link = self.marks.pop()
            text = _SPACE.sub(" ", "".join(self.line[start:]))
            del self.line[start:]
            core = text.strip()
            if core:
                sign = MARKS.get(name, "")
                core = f"[{core}]({link})" if name == "a" and link else f"{sign}{core}{sign}"
                self.line.append((" " if text[0] == " " else "") + core + (" " if text[-1] == " " else ""))
            else:
                self.line.append(text)
            if name == tag:
                return

    def text_of_line(self) -> str:
        while self.marks:
            self.close_mark(self.marks[-1][0])
        text, self.line = "".join(self.line), []
        if "\n" not in text:
            return _BLANK.sub(" ", text).strip()
        lines = [_BLANK.sub(" ", x).strip() for x in text.split("\n")]
        return "\n".join(x for x in lines if x)

    def end_block(self, kind: str = "text") -> None:
        """The line is a block; what follows is of ``kind``."""
        if self.cell:
            self.line.append(" ")
            return
        text = self.text_of_line()
        if text:
            self.blocks.append((self.kind, ("#" * HEADINGS[self.kind] + " " + text.replace("\n", " ")) if self.kind in HEADINGS else text))
        self.kind = kind

    # -- tags ---------------------------------------------------------------------------------------------------
    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.open(tag, dict(attrs))

    def open(self, tag: str, own: dict) -> None:
        if self.skipped or tag in SKIPPED:
            if tag in SKIPPED:
                self.skipped.append(tag)
            return
        if self.fence is not None:
            found = re.search(r"(?:language|lang)-([A-Za-z0-9_+-]+)", own.get("class") or "")
            self.language = self.language or (found[1] if found else "")
            if tag == "br":
                self.fence.append("\n")
        elif tag == "pre" and not self.cell:
            self.end_block()
            self.fence, self.language = [], ""
            self.open("code", own)
        elif tag == "table":
            if not self.tables:
                self.end_block()
                self.rows, self.header = [], False
            self.tables += 1
        elif tag in ("tr", "td", "th") and self.tables == 1:
            self.end_cell()
            if tag == "tr" or not self.rows:
                self.rows.append([])
            if tag != "tr":
                self.cell = True
                self.header = self.header or (tag == "th" and len(self.rows) == 1)
        elif tag in MARKS or tag == "a":
            self.marks.append((tag, len(self.line), own.get("href") or ""))
        elif tag == "br":
            self.line.append(" " if self.cell else "\n")
        elif tag == "li":
            n = self.lists[-1] if self.lists else None
            self.end_block("item" if n is None else f"item{n}")
            if n is not None:
                self.lists[-1] = n + 1
        elif tag in HEADINGS:
            self.end_block(tag)
        elif tag in BLOCKS:
            self.end_block()
            if tag in ("ul", "ol"):
                self.lists.append(1 if tag == "ol" else None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr"):
            self.open(tag, dict(attrs))

    def write(self, html: str) -> None:
        """Reads a whole page."""
        parts = _TAG.split(html)
        tags = _plain_tags(parts) if html.count("<") == len(parts) // 2 else None
        if tags is None:
            self.feed(html)
            self.close()
            return
        i, n = 0, len(tags)
        while i < n:
            text, (kind, name, own) = parts[2 * i], tags[i]
            i += 1
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if kind == END:
                self.handle_endtag(name)
            elif kind != EMPTY:
                if (name == "td" or name == "th") and self.tables == 1 and i < n and tags[i][0] == END and tags[i][1] == name and self.fence is None and not self.skipped and not self.marks:
                    self.whole_cell(name, parts[2 * i])
                    i += 1
                else:
                    self.open(name, own)
            elif name in ("br", "hr"):
                self.open(name, own)
        if parts[-1]:
            self.handle_data(unescape(parts[-1]) if "&" in parts[-1] else parts[-1])

    def whole_cell(self, tag: str, text: str) -> None:
        """A cell that holds text alone."""
        if self.cell or self.line:
            self.open(tag, {})
            self.handle_data(unescape(text) if "&" in text else text)
            self.end_cell()
            return
        if not self.rows:
            self.rows.append([])
        self.header = self.header or (tag == "th" and len(self.rows) == 1)
        text = _SPACE.sub(" ", unescape(text) if "&" in text else text).strip()
        self.rows[-1].append(text.replace("|", "\\|"))

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                del self.skipped[self.skipped.index(tag) :]
        elif self.fence is not None:
            if tag == "pre":
                self.end_fence()
        elif tag == "table":
            self.tables -= self.tables > 0
            if not self.tables:
                self.end_table()
        elif tag in ("tr", "td", "th") and self.tables == 1:
            self.end_cell()
        elif tag in MARKS or tag == "a":
            self.close_mark(tag)
        elif tag in HEADINGS or tag in BLOCKS or tag == "li":
            self.end_block()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.fence is not None:
            self.fence.append(data)
        elif self.cell or not self.tables:
            self.line.append(_SPACE.sub(" ", data))

    # -- fences and tables --------------------------------------------------------------------------------------
    def end_fence(self) -> None:
        text = "".join(self.fence or []).strip("\n")
        self.fence = None
        if text.strip():
            self.blocks.append(("fence", f"```{self.language}\n{text}\n```"))

    def end_cell(self) -> None:
        if self.cell:
            self.cell = False
            self.rows[-1].append(self.text_of_line().replace("\n", " ").replace("|", "\\|"))

    def end_table(self) -> None:
        self.end_cell()
        rows = [r for r in self.rows if any(r)]
        if not rows:
            return
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        if self.header:
            lines.insert(1, "|" + " --- |" * width)
        self.blocks.append(("table", "\n".join(lines)))
        self.kind = "text"

    def markdown(self) -> str:
        if self.fence is not None:
            self.end_fence()
        if self.tables:
            self.end_table()
        self.cell = False
        self.end_block()
        out, last = "", ""
        for kind, text in self.blocks:
            item = kind.startswith("item")
            line = f"{kind[4:] + '.' if kind[4:] else '-'} {text}" if item else text
            out += ("" if not out else "\n" if item and last.startswith("item") else "\n\n") + line
            last = kind
        return out


def structured_markdown(html: str | None) -> str | None:
    """Markdown of one page."""
    if html is None:
        return None
    w = _Writer()
    w.write(html)
    return w.markdown()


def markdown_with_structure(html: Column) -> Column:
    """Column of markdown, by Arrow batches."""

    @F.pandas_udf("string")
    def written(batch: pd.Series) -> pd.Series:
        return pd.Series([structured_markdown(x) for x in batch], dtype=object)

    return written(html)

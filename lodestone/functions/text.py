"""Column functions on text: words, token estimates, links, hashes, markdown from HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are Unicode letters, digits and underscores; Java's own ``\w`` knows only ASCII.
WORD = r"[\p{L}\p{N}_]+"
#: Fixed value: what a line of a log holds.
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}"
#: Fixed value: a link, the first group being its text.
LINK = r"\[([^\]]+)\]\([^)]+\)"
#: (pattern, replacement) in order; ``$1`` is a group.
HTML_RULES: tuple[tuple[str, str], ...] = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?is)<head(\s[^>]*)?>.*?</head>", ""),
    *((rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)),
    (r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(p|div|ul|ol|nav|article|section|footer|header|main|body|html|table|tr)(\s[^>]*)?>", "\n\n"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n\n+", "\n\n"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """max(1, words / 0.75 cut down), in whole numbers."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * 4 / 3)).cast("int")


def link_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(1))


def normalised_hash(text: Column) -> Column:
    """md5 of a block without link targets, ISO dates and repeated white space."""
    plain = F.regexp_replace(text, LINK, "[$1]")
    plain = F.regexp_replace(plain, r"\d{4}-\d{2}-\d{2}", "")
    return F.md5(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def markdown_from_html(html: Column) -> Column:
    out = html
    for pattern, replacement in HTML_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def promote_headings(markdown: Column) -> Column:
    """A line of bold text alone (3 to 79 characters, not ending in ``. , ; :``) before a blank line or the end becomes a heading."""
    return F.regexp_replace(markdown, r"(?m)^\*\*(?=[^*\n]{3,79}\*\*[ \t]*$)([^*\n]*[^*\n.,:;])\*\*[ \t]*(?=\n[ \t]*(?:\n|\z)|\z)", "## $1")


def strip_repeats(text: Column) -> Column:
    """Without zero-width characters; phrases of 3 to 11 words that stand twice in a row stand once."""
    clean = F.translate(text, "​‌‍﻿­", "")
    return F.regexp_replace(clean, r"(?U)\b(\w+(?:\s+\w+){2,10})\s+\1\b", "$1")


def suspicious_text(text: Column) -> Column:
    """No line with text, or such lines are shorter than 5 characters on average."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    return (F.size(lines) == 0) | (total < 5 * F.size(lines))


def looks_like_log(text: Column) -> Column:
    """Over 40 % of lines hold a full timestamp, date and time to the second."""
    lines = F.split(text, "\n")
    stamped = F.size(F.filter(lines, lambda x: x.rlike(TIMESTAMP)))
    return stamped * 10 > F.size(lines) * 4


def identifier_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def has_sublist(tokens: Column, part: Column) -> Column:
    """Whether ``part`` stands in ``tokens`` in one stretch; an empty one always does."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return (F.size(part) == 0) | F.contains(joined, F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" ")))

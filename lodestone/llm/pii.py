"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Candidates are found by their form and validated (card numbers by their check digit, account numbers by their
remainder, addresses by the range of their parts, dates by the calendar). A valid value is permuted within its own
format by a Feistel network over its digits or letters, keyed with a secret and tweaked by its kind and size: a
card stays a card with a right check digit, a date stays a date, separators and letter case stay where they were.
The permutation is one for the whole corpus, so equal values stay equal in every document and different ones
different, and whoever holds the key can map them back (``Feistel.back``).

Kinds: email (the part before the @), phone, card, iban, ssn, ip, date (of the years 1900 to 2099), secret (long
hexadecimal strings; values of names that end in token, key, secret or password, assigned or as JSON or YAML has
them). Values don't span lines. Time grows with a line's length, not its square, and long values are permuted whole.

Defined results: a null text stays null with counts 0; an empty text stays empty; very long texts are read whole,
line by line; rows, repeated ones too, come back as they went in with only the text changed; an empty table gives
an empty table. Other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import table, unused_name

ROUNDS = 10
KEY_SETTING = "lodestone.pii.key"
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
#: Sets of up to this many numbers leave none in place; strings over so many characters are permuted by characters.
RING, LONG = 10_000, 24
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


class Feistel:
    """Permutes, for each kind, the numbers 0 .. size - 1 or the strings over an alphabet: keyed rounds over two halves.

    Numbers are walked back into range. Sets of up to ``RING`` numbers go to the next one in their permuted order, so
    that none keeps its place. Strings over ``LONG`` characters are permuted character by character, in linear time.
    """

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.sha256(key).digest()
        self.moved = lru_cache(maxsize=100_000)(self._moved)

    def _stream(self, kind: str, k: int, size: bytes, half: bytes, n: int) -> bytes:
        """``n`` pseudo-random bytes of a round."""
        parts = (kind.encode(), bytes([k]), size, half)
        return hashlib.shake_256(self.key + b"".join(len(p).to_bytes(4, "big") + p for p in parts)).digest(n)

    def _round(self, kind: str, k: int, size: int, half: int, modulus: int) -> int:
        data = self._stream(kind, k, _as_bytes(size), _as_bytes(half), (modulus.bit_length() + 7) // 8 + 16)
        return int.from_bytes(data, "big") % modulus

    def _once(self, x: int, a: int, b: int, kind: str, size: int, back: bool) -> int:
        u, v = divmod(x, b)
        for k in range(ROUNDS)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if k % 2:
                v = (v + sign * self._round(kind, k, size, u, b)) % b
            else:
                u = (u + sign * self._round(kind, k, size, v, a)) % a
        return u * b + v

    def _permuted(self, x: int, size: int, kind: str, back: bool) -> int:
        a = isqrt(size)
        b = -(-size // a)
        y = self._once(x, a, b, kind, size, back)
        while y >= size:
            y = self._once(y, a, b, kind, size, back)
        return y

    def _moved(self, x: int, size: int, kind: str, back: bool = False) -> int:
        if size < 2:
            return x
        if size <= RING:
            return self._permuted((self._permuted(x, size, kind, False) + (-1 if back else 1)) % size, size, kind, True)
        return self._permuted(x, size, kind, back)

    def back(self, y: int, size: int, kind: str) -> int:
        return self.moved(y, size, kind, True)

    def text(self, s: str, alphabet: str, kind: str, back: bool = False) -> str:
        """``s``, all of it in ``alphabet``, as another string of its length."""
        base = len(alphabet)
        if len(s) > LONG:
            return self._long_text(s, alphabet, kind, back)
        x = 0
        for c in s:
            x = x * base + alphabet.index(c)
        y, out = self.moved(x, base ** len(s), kind, back), []
        for _ in s:
            y, r = divmod(y, base)
            out.append(alphabet[r])
        return "".join(reversed(out))

    def _long_text(self, s: str, alphabet: str, kind: str, back: bool) -> str:
        base, place = len(alphabet), {c: k for k, c in enumerate(alphabet)}
        x = np.fromiter(map(place.__getitem__, s), np.int64, len(s))
        halves, size = [x[: len(x) // 2], x[len(x) // 2 :]], f"{base}:{len(s)}".encode()
        for k in range(ROUNDS)[:: -1 if back else 1]:
            own, other = halves[k % 2], halves[1 - k % 2]
            noise = np.frombuffer(self._stream(kind, k, size, other.astype("<u2").tobytes(), 8 * len(own)), "<u8")
            halves[k % 2] = (own + (-1 if back else 1) * (noise % np.uint64(base)).astype(np.int64)) % base
        return "".join(map(alphabet.__getitem__, np.concatenate(halves).tolist()))


def _as_bytes(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")


def luhn_digit(digits: str) -> str:
    """The check digit that makes a card number of ``digits``."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_remainder(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _poured(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced, in turn, by ``chars``; letter case as it was."""
    it = iter(chars)
    return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(it)) else c for c in shape)


def _card(f: Feistel, s: str) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = f.text(d[:-1], DIGITS, "card")
    return _poured(s, n + luhn_digit(n))


def _phone(f: Feistel, s: str) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 7 <= len(d) <= 15:
        return None
    head = re.match(r"\+(\d{1,3})(?=\D)", s)
    keep = len(head[1]) if head else 0
    return _poured(s, d[:keep] + f.text(d[keep:], DIGITS, "phone"))


def _iban(f: Feistel, s: str) -> str | None:
    c = s.replace(" ", "")
    if not 15 <= len(c) <= 34 or iban_remainder(c) != 1:
        return None
    body = c[4:].lower()
    digits = iter(f.text("".join(x for x in body if x in DIGITS), DIGITS, "iban"))
    letters = iter(f.text("".join(x for x in body if x in LETTERS), LETTERS, "iban"))
    new = "".join(next(digits) if x in DIGITS else next(letters) for x in body).upper()
    return _poured(s, f"{c[:2]}{98 - iban_remainder(c[:2] + '00' + new):02d}{new}".lower())


#: The areas 001-665 and 667-899, groups 01-99, serials 0001-9999.
SSN_SIZE = 898 * 99 * 9999


def _ssn(f: Feistel, s: str) -> str | None:
    a, g, n = map(int, s.split("-"))
    if not (0 < a < 900 and a != 666 and g and n):
        return None
    x = f.moved(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, SSN_SIZE, "ssn")
    x, n = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{n + 1:04d}"


def _ip(f: Feistel, s: str) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in s.split(".")):
        return None
    x = f.moved(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(f: Feistel, s: str) -> str | None:
    p = re.split(r"([-/.])", s)
    try:
        y, m, d = (int(p[0]), int(p[2]), int(p[4])) if len(p[0]) == 4 else (int(p[4]), int(p[2]), int(p[0]))
        american = m > 12 and len(p[0]) < 4
        at = date(y, d, m).toordinal() if american else date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= at < FIRST_DAY + DAYS:
        return None
    new = date.fromordinal(FIRST_DAY + f.moved(at - FIRST_DAY, DAYS, "date"))
    one, two = (new.day, new.month) if american else (new.month, new.day)
    return f"{new.year:04d}{p[1]}{one:02d}{p[3]}{two:02d}" if len(p[0]) == 4 else f"{two:02d}{p[1]}{one:02d}{p[3]}{new.year:04d}"


@lru_cache(maxsize=4_096)
def _letters_near(page: int) -> str:
    """The lower-case or caseless letters among 256 neighbouring code points; of the first 128 there are only a to z."""
    if page == 0:
        return "".join(c for c in map(chr, range(128, 256)) if c.isalpha() and c.lower() == c)
    return "".join(c for c in map(chr, range(page << 8, (page + 1) << 8)) if c.isalpha() and c.lower() == c)


def _by_class(f: Feistel, s: str, kind: str) -> str:
    """Digits among digits and letters among letters (others than a to z among their neighbours), apart from each other; other characters stay."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in s]

    def alphabet(c: str) -> str:
        near = DIGITS if c in DIGITS else LETTERS if c in LETTERS else _letters_near(ord(c) >> 8)
        return near if c in near else ""

    own = [alphabet(c) for c in low]
    new = {a: iter(f.text("".join(c for c, x in zip(low, own) if x == a), a, kind)) for a in dict.fromkeys(own) if a}
    out = [next(new[a]) if a else c for c, a in zip(low, own)]
    return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n if c.lower() == x else c for c, n, x in zip(s, out, low))


def _email(f: Feistel, s: str) -> str | None:
    local, _, domain = s.rpartition("@")
    return f"{_by_class(f, local, 'email')}@{domain}" if any(map(str.isalnum, local)) else None


def _secret(f: Feistel, s: str) -> str | None:
    low = s.lower()
    if all(c in HEX for c in low):
        return _poured(s, f.text(low, HEX, "secret"))
    return _by_class(f, s, "secret")


#: ``password="..."``, ``"api_key": "..."``, ``token: ...`` and the like; the value is one of the groups.
_NAMED = r"(?:(?<![A-Za-z])|(?<=[Aa][Pp][Ii])|(?<=[Aa]ccess)|(?<=[Aa]uth)|(?<=[Cc]lient)|(?<=[Pp]rivate))(?i:password|passwd|passphrase|secret|token|key)[\"']?[ \t]{0,8}[:=][ \t]{0,8}(?:\"([^\"\s]{8,}+)\"|'([^'\s]{8,}+)'|([\w+/.~-]{8,}+={0,2}))"
_NAMED_VALUE = re.compile(_NAMED)


def _named_secret(f: Feistel, s: str) -> str | None:
    m = _NAMED_VALUE.match(s)
    value = m[m.lastindex]
    # Prose has "the key: something"; bare values count if they hold a digit, and so does a JSON field that is just "key".
    plain = m.lastindex == 3 or (s[:4].lower() == "key\"" or s[:4].lower() == "key'")
    if plain and not any(c in DIGITS for c in value):
        return None
    return f"{s[: m.start(m.lastindex)]}{_secret(f, value)}{s[m.end(m.lastindex) :]}"


FORMS: tuple[tuple[str, str, Callable[[Feistel, str], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _email),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])", _secret),
    ("secret", _NAMED, _named_secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", _ip),
    ("date", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-])", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4})(?![\d@])", _phone),
)
#: Each form alone, and what must not follow it.
_FORM = [re.compile(pattern) for _, pattern, _ in FORMS]
_AFTER = [re.compile(m[0] if (m := re.search(r"\(\?![^()]*\)$", pattern)) else "") for _, pattern, _ in FORMS]
#: No form but e-mails and secrets, which have one end each, is longer.
MOST = 48
_NAME, _DIGIT, _LONG_HEX = re.compile(r"(?i:passw|passphrase|secret|token|key)"), re.compile(r"[0-9]"), re.compile(r"[0-9a-fA-F]{32}")


@lru_cache(maxsize=16)
def _any_of(email: bool, named: bool, long_hex: bool, digits: bool) -> re.Pattern:
    """The forms that a line can have, in one pattern."""
    has = [email, long_hex, named, *[digits] * (len(FORMS) - 3)]
    return re.compile("|".join(f"(?P<f{k}>{re.sub(r'(?<!\\)\((?!\?)', '(?:', pattern)})" for k, (_, pattern, _) in enumerate(FORMS) if has[k]))


def _forms_of(line: str) -> re.Pattern | None:
    has = "@" in line, _NAME.search(line) is not None, _LONG_HEX.search(line) is not None, _DIGIT.search(line) is not None
    return _any_of(*has) if any(has) else None


def _valid_at(line: str, start: int, first: int, feistel: Feistel) -> tuple[int, str, str] | None:
    """(end, kind, pseudonym) of a valid value at ``start``: of the first form from ``first`` on, its longest valid end."""
    for k in range(first, len(FORMS)):
        if (m := _FORM[k].match(line, start)) is None:
            continue
        for end in range(m.end(), max(start, m.end() - MOST), -1):
            # A shorter end must be one that the form could have where it stands.
            if end < m.end() and not (_AFTER[k].match(line, end) and _FORM[k].fullmatch(line, start, end)):
                continue
            if (new := FORMS[k][2](feistel, line[start:end])) is not None:
                return end, FORMS[k][0], new
            if m.end() - start > MOST:
                break
    return None


def _replaced(line: str, forms: re.Pattern, feistel: Feistel, found: dict[str, int]) -> str:
    """``line`` with its valid values replaced. A candidate that isn't valid hides nothing: search goes on one character past its start."""
    out, done, at = [], 0, 0
    while (m := forms.search(line, at)) is not None:
        valid = _valid_at(line, m.start(), int(m.lastgroup[1:]), feistel)
        if valid is None:
            at = m.start() + 1
            continue
        end, kind, new = valid
        out += [line[done : m.start()], new]
        found[kind] += 1
        done = at = end
    return "".join([*out, line[done:]])


def pseudonymised(text: str | None, feistel: Feistel) -> tuple[str | None, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind."""
    found = dict.fromkeys(KINDS, 0)
    if not text or _forms_of(text) is None:
        return text, found

    lines = text.split("\n")
    for k, line in enumerate(lines):
        if (forms := _forms_of(line)) is not None:
            lines[k] = _replaced(line, forms, feistel, found)
    return "\n".join(lines), found


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", found: str | None = "pii_found") -> DataFrame:
    """``df`` with ``text`` pseudonymised and, if named, a struct column of counts by kind, which replaces one of its name."""
    fields = ", ".join(f"{k} int" for k in KINDS)

    @F.pandas_udf(f"text string, {fields}")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        feistel = Feistel(key)
        for batch in batches:
            out = [pseudonymised(t if isinstance(t, str) else None, feistel) for t in batch]
            counts = {k: pd.Series([c[k] for _, c in out], dtype="int32") for k in KINDS}
            yield pd.DataFrame({"text": pd.Series([t for t, _ in out], dtype=object)} | counts)

    both = unused_name(df, "pseudonymised")
    done = df.withColumn(both, masked(F.col(text))).withColumn(text, F.col(f"{both}.text"))
    if found:
        done = done.withColumn(found, F.struct(*[F.col(f"{both}.{k}").alias(k) for k in KINDS]))
    return done.drop(both)


def session_key(spark) -> bytes:
    """The session's secret, ``lodestone.pii.key``. Where it names none, a random one is drawn and set: pseudonyms then hold for this session only."""
    secret = spark.conf.get(KEY_SETTING, None)
    if not secret:
        secret = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, secret)
    return hmac.new(b"pseudonyms", secret.encode(), "sha256").digest()


def op5_pii(spark, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return done.select("doc_id", "text", *[F.col(f"pii_found.{k}").alias(f"n_{k}") for k in KINDS])

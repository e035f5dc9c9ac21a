"""Secrets in texts: fixed patterns, and literals that sensitive names receive.

The lexer reads assignments of source and configuration syntax into names and values: quoted,
raw, triple-quoted and template strings with escapes, concatenations of strings and constants,
bare words, and indented blocks. Names that stand for constants are followed wherever in the
text these are defined, and each literal is scored by the parts of the names that it reaches
and by its own look. Scans run text by text without any shuffle, in time linear in the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so shorter ones never hide longer
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weights of the parts of a target name.
NAME_PARTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.4, "api": 0.4, "access": 0.4, "auth": 0.5, "key": 0.5, "signing": 0.3, "client": 0.1, "salt": 0.5}
LEAST_SCORE = 1.0
_PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|example.*|placeholder|your[-_ ]?.*|none|null|true|false|todo|test|dummy|x+|\*+|<.*>|\$\{.*\}|\$\w+|%\w+%)$")
# possessive, so that a text is read without going back and nothing needs a greatest length
_TARGET = re.compile(r"""(?<![\w.\-])["'`]?([A-Za-z_][\w.\-]*+)["'`]?[ \t]*+(?::[ \t]*+[A-Za-z_][\w.<>\[\]]*+[ \t]*+=(?!=)|:=|=>|=(?![=>])|:(?![:/=]))[ \t]*+""")
_STRING = re.compile(r"""([rRbBuUfF]{0,2})(?:(\"{3}|'{3})|"((?:[^"\n\\]|\\.)*+)"|'((?:[^'\n\\]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""", re.S)
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>]++""")
_NAME = re.compile(r"[A-Za-z_][\w.]*+(?![\w.(\[])")
_JOIN = re.compile(r"[ \t]*+(?:(?:\+|\.{1,2})[ \t]*+(?:(?:\\|//[^\n]*+|\#[^\n]*+)?\r?\n\s*+)?|\\\r?\n\s*+)?")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*+\r?\n")
_LINE = re.compile(r"([ \t]++)(-----[^\n]*+|[^\s:|>]++\r?)(?:\n|$)")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", re.S)
_BETWEEN = re.compile(r"[\s\"'`+.()\\rRbBuUfF]*+")
_SENSITIVE = re.compile("pass|pwd|secret|token|cred|auth|key|salt", re.I | re.A)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """Sum of the weights of a name's parts, split at case changes, digits and separators."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return sum(NAME_PARTS.get(p, 0.0) for p in [*parts, *(j for j in joined if j == "apikey")])


def literal_score(value: str) -> float:
    """0 to 1 by length, entropy and mix of characters; placeholders, plain words and values with blanks have 0.

    Lines of a longer value are joined, without the marks of a key's begin and end.
    """
    if "\n" in value:
        value = "".join(x.strip() for x in value.splitlines() if not x.strip().startswith("-----"))
    n = len(value)
    if n < 8 or _PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    if kinds < 2 or not any(c.isdigit() for c in value):
        return 0.0
    return min(1.0, entropy / 3.5) * min(1.0, 0.5 + kinds / 6)


def _unescaped(raw: str) -> str:
    """A string's characters; escaped control characters fall away, as they part lines of a key."""
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else "" if m[3] in "nrt\n" else m[3], raw) if "\\" in raw else raw


class _Part(NamedTuple):
    value: str  # of a literal, or the name of a constant
    start: int  # -1 for a constant
    end: int


class _Lexer:
    """Values of one text. Where no closing mark follows once, none does later."""

    def __init__(self, text: str) -> None:
        self.text, self.open = text, set()

    def string(self, at: int) -> tuple[_Part, int] | None:
        """A string literal at ``at`` and where it ends."""
        m = _STRING.match(self.text, at)
        if not m:
            return None
        raw = "r" in m[1].lower()
        if m[2]:
            close = -1 if m[2] in self.open else self.text.find(m[2], m.end())
            if close < 0:
                self.open.add(m[2])
                return None
            value = self.text[m.end() : close]
            return _Part(value if raw else _unescaped(value), m.end(), close), close + 3
        group = m.lastindex or 1
        a, b = m.span(group)
        return _Part(m[group] if raw else _unescaped(m[group]), a, b), m.end()

    def block(self, at: int) -> _Part | None:
        """The indented lines of a key after a block mark; lines of several words or with names are none."""
        m = _BLOCK.match(self.text, at)
        if not m:
            return None
        begin = at = m.end()
        lines, indent = [], None
        while line := _LINE.match(self.text, at):
            if indent is not None and not line[1].startswith(indent):
                break
            indent = indent or line[1]
            lines.append(line[2])
            at = line.end()
        return _Part("\n".join(lines), begin + len(indent or ""), at - (self.text[at - 1] == "\n")) if lines else None

    def value(self, at: int, mapped: bool) -> list[_Part]:
        """The literals and constants that the expression at ``at`` joins."""
        if mapped and (block := self.block(at)):
            return [block]
        parts: list[_Part] = []
        inside = self.text.startswith("(", at)  # strings may stand on lines of their own
        at += inside
        while True:
            if inside:
                while at < len(self.text) and self.text[at].isspace():
                    at += 1
            if found := self.string(at):
                parts.append(found[0])
                at = found[1]
            elif parts and not (m := _NAME.match(self.text, at)):
                return parts
            elif parts:
                parts.append(_Part(m[0], -1, -1))
                at = m.end()
            else:
                m = _BARE.match(self.text, at)
                if not m:
                    return []
                name = _NAME.match(self.text, at)
                joined = _JOIN.match(self.text, name.end()) if name else None
                if not name or not (joined[0].strip() and self.text[joined.end() : joined.end() + 1] in ("'", '"', "`")):
                    return [_Part(m[0], *m.span())]
                parts.append(_Part(name[0], -1, -1))
                at = name.end()
            follows = _JOIN.match(self.text, at)
            if not follows[0].strip() and not self.string(follows.end()) and not inside:
                return parts
            if not follows[0].strip() and inside and self.text[follows.end() : follows.end() + 1] not in ("'", '"', "\n", "\r"):
                return parts
            at = follows.end()


def lexed_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly, joined with others, or through constants.

    A constant is the definition of its name before the use, else the first one after it. Joined
    literals are one span, and each constant in a joined value has its own.
    """
    lexer, pairs, where, at = _Lexer(text), [], {}, 0
    while m := _TARGET.search(text, at):
        at = m.end()
        if parts := lexer.value(at, m[0].rstrip().endswith(":")):
            where.setdefault(m[1].rpartition(".")[2], []).append(len(pairs))
            pairs.append((m[1], parts))

    def constant(i: int, part: _Part) -> int | None:
        """The definition that a part of value ``i`` stands for."""
        found = where.get(part.value.rpartition(".")[2]) if part.start < 0 or not _quoted(text, part) else None
        if not found:
            return None
        k = bisect_left(found, i)
        return found[k - 1] if k else next((x for x in found if x != i), None)

    known: dict[int, dict[_Part, None]] = {}

    def leaves(first: int) -> dict[_Part, None]:
        """The literals of a value, with those of its constants in their places; a name in its own value is none."""
        path = [first]
        while path:
            i, wait, out = path[-1], None, {}
            for part in pairs[i][1]:
                j = constant(i, part)
                if j is not None and j not in known and j not in on_path:
                    wait = j
                    break
                if j in known:
                    out |= known[j]
                elif j is None and part.start >= 0:
                    out[part] = None
            if wait is None:
                known[i] = out
                on_path.discard(path.pop())
            else:
                path.append(wait)
                on_path.add(wait)
        return known[first]

    spans = []
    for i, (name, _) in enumerate(pairs):
        if not _SENSITIVE.search(name) or name_score(name) < 0.5:
            continue
        on_path = {i}
        found = list(known[i] if i in known else leaves(i))
        look = literal_score("".join(x.value for x in found))
        if look > 0 and name_score(name) + look >= 0.5 + LEAST_SCORE:
            run: list[_Part] = []
            for part in found:
                if run and (part.start < run[-1].end or not _joins(text, run[-1].end, part.start)):
                    spans.append((run[0].start, run[-1].end))
                    run = []
                run.append(part)
            spans.append((run[0].start, run[-1].end))
    return spans


def _quoted(text: str, part: _Part) -> bool:
    """Whether a literal stands in quotes (or is a block), so that it names no constant."""
    return part.start == 0 or text[part.start - 1] in "\"'`" or "\n" in part.value


def _joins(text: str, a: int, b: int) -> bool:
    """Whether only quotes, joining signs and blanks are between two literals, however many."""
    return _BETWEEN.fullmatch(text, a, b) is not None


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind; code points, end exclusive."""
    low = text.lower()
    spans = []
    if any(w in low for w in _WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if ("=" in text or ":" in text) and _SENSITIVE.search(text):
        have = [(a, b) for _, a, b in spans]
        spans += [("literal", a, b) for a, b in dict.fromkeys(lexed_literals(text)) if not any(x <= a and b <= y for x, y in have)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``, one row per row of ``docs``; null texts are empty and repeated rows stay."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"doc_id long, spans {_SPANS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: str) -> Column:
        return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")

    base = "filter(spans, s -> s.kind <> 'literal')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))

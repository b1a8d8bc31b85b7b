"""Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into (name, literal) pairs, constants are propagated through later references
and concatenations, and each literal is scored by how sensitive the name it reaches is. Three plain rules (assignments to
a short list of names, access key ids, long hex runs) are always reported beside these.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import OWN, ship

KINDS = ("assign", "access", "hex", "literal")
_RANK = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# A name, an operator and the first operand; operands are quoted literals, names or bare configuration values.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])({_NAME})["'\]]{{0,2}}[ \t]*(?::=|=>|=|:)[ \t]*(?=(["'`A-Za-z0-9_$+/]))""", re.A
)
_OPERAND = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([A-Za-z0-9_+/.=$\-]++))""", re.A)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|&)[ \t]*(?=[\"'`A-Za-z_])", re.A)
_IDENT = re.compile(rf"{_NAME}\Z", re.A)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

#: How far a word in a target's name speaks for a secret.
SENSITIVE = {
    "password": 0.7, "passwd": 0.7, "pwd": 0.6, "passphrase": 0.7, "pass": 0.4, "secret": 0.7, "token": 0.6, "apikey": 0.7,
    "credential": 0.6, "credentials": 0.6, "auth": 0.4, "bearer": 0.6, "private": 0.4, "signing": 0.4, "encryption": 0.4,
    "access": 0.3, "client": 0.1, "session": 0.3, "key": 0.3, "api": 0.3, "salt": 0.3, "cookie": 0.3, "dsn": 0.3,
}
#: Words that mark a value as standing for a secret and not being one.
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|placeholder|your[_-]|xxxx|\*{3}|dummy|^(none|null|true|false|todo|test)$|\$\{|\{\{|^<.*>$")


def name_weight(name: str) -> float:
    parts = [p for p in _SPLIT.split(re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if p]
    return min(0.8, sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(parts)))


def literal_weight(value: str) -> float:
    """0 to 0.5 by length, mix of character kinds and entropy; below zero for placeholders."""
    if len(value) < 6 or PLACEHOLDER.search(value):
        return -1.0
    if " " in value and not re.search(r"\d", value):
        return -0.4
    n = len(value)
    h = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(0.5, 0.04 * min(n, 5) * (kinds - 1) * 0.5 + 0.06 * max(0.0, h - 1.5))


#: Pieces up to which an assignment's constants are expanded as often as they are named, and then once each.
EXPANDED = 64


def assignments(text: str) -> Iterator[tuple[str, list]]:
    """(name, parts) of each assignment in order; a part is the (start, end) of a literal or, for a reference to a constant,
    the list of that constant's own parts. No part holds text, so long values that lie in each other take no memory."""
    known: dict[str, list] = {}
    longest = begin = stop = 0
    for m in _PAIR.finditer(text):
        parts: list = []
        at = m.end()
        while True:
            if begin <= at < stop:  # within the last bare value, which ends where that ends
                s, e, bare = at, stop, True
                at = e
            else:
                o = _OPERAND.match(text, at)
                if not o:
                    break
                g = o.lastindex
                s, e, bare, at = o.start(g), o.end(g), g == 4, o.end()
                if bare:
                    begin, stop = s, e
            constant = known.get(text[s:e]) if bare and e - s <= longest else None
            if constant is not None:
                parts.append(constant)
            elif not bare or not parts:
                parts.append((s, e))
            j = _JOIN.match(text, at)
            if not j:
                break
            at = j.end()
        if parts:
            known[m[1]] = parts
            longest = max(longest, len(m[1]))
            yield m[1], parts


def expanded(parts: list) -> list[tuple[int, int]]:
    """The spans of an assignment's literals in order, those of its constants among them: every one is there, and beyond
    EXPANDED pieces none is expanded again."""
    out: list[tuple[int, int]] = []
    seen: set[int] = set()
    todo = [iter(parts)]
    while todo:
        for p in todo[-1]:
            if isinstance(p, tuple):
                out.append(p)
            elif len(out) <= EXPANDED or id(p) not in seen:
                seen.add(id(p))
                todo.append(iter(p))
                break
        else:
            todo.pop()
    return out


def scan(text: str | None, threshold: float = 0.75) -> list[tuple[str, int, int, str, float]]:
    """Spans (kind, start, end, name, score) of one text, code points with the end exclusive, by start and then by kind."""
    if not text:
        return []
    out = [("assign", m.start(), m.end(), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), "", 1.0) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), "", 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text:
        found: dict[tuple[int, int], tuple[float, str]] = {}
        for name, parts in assignments(text):
            w = name_weight(name)
            if w <= 0:
                continue
            spans = expanded(parts)
            score = w + literal_weight("".join([text[s:e] for s, e in spans]))
            if score >= threshold:
                for s, e in spans:
                    if e > s:
                        found[s, e] = max(found.get((s, e), (0.0, "")), (round(min(score, 1.0), 4), name))
        # a literal within a span of the plain rules is left out: of those that begin no later, the farthest end tells
        starts, reach = [], []
        for _, a, b, *_ in sorted(out, key=lambda x: x[1]):
            starts.append(a)
            reach.append(max(b, reach[-1]) if reach else b)
        for (s, e), (score, name) in found.items():
            k = bisect_right(starts, s)
            if not k or reach[k - 1] < e:
                out.append(("literal", s, e, name, score))
    return sorted(out, key=lambda x: (x[1], _RANK[x[0]], x[2]))


def redact(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """The text with each covered stretch replaced by mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for _, s, e, *_ in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _mapped(df: DataFrame, text: str, output: str, kind: T.DataType, f, arrow: pa.DataType) -> DataFrame:
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(output, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, text):
                col = pa.array([f(t) for t in b.column(text).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], col], names=[*keep, output])

    return df.mapInArrow(run, schema)


def find_secrets(df: DataFrame, text: str = "text", threshold: float = 0.75, output: str = "secrets") -> DataFrame:
    """Adds `output`, the array of spans of each row's whole text (empty for a null or empty text). Rows are independent:
    no shuffle, repeated rows and ties need no rule, other columns pass through and an empty table stays empty. A column
    named `output` is replaced."""
    keys = ("kind", "start", "end", "name", "score")
    fields = [T.StringType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.DoubleType()]
    kind = T.ArrayType(T.StructType([T.StructField(k, t) for k, t in zip(keys, fields, strict=True)]))
    arrow = pa.list_(pa.struct(list(zip(keys, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()], strict=True))))
    return _mapped(df, text, output, kind, lambda t: [dict(zip(keys, x, strict=True)) for x in scan(t, threshold)], arrow)


def redact_secrets(df: DataFrame, text: str = "text", threshold: float = 0.75, mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span found in `text` by mark; null and empty texts stay as they are."""
    clean = _mapped(df, text, OWN, T.StringType(), lambda t: redact(t, scan(t, threshold), mark), pa.string())
    return clean.select(*[F.col(OWN).alias(text) if c == text else F.col(c) for c in df.columns])

"""Secret scan that links the parts of a credential within a scope.

Strong findings stand alone: assignments to secret-like names, access identifiers and long
hexadecimal runs. Weak candidates (client names, mixed tokens, endpoints) mean little alone.
They are linked by an interval join: every identifier opens a scope of ``radius`` characters
to either side, cut at blank lines, and the secrets and endpoints that reach into it, however
long they are, are its parts. A weak candidate is reported only if its complementary parts are there:

- a weak secret needs a strong access identifier in its scope, or a weak one and an endpoint;
- a weak identifier needs a strong secret in its scope, or a weak secret and an endpoint;
- an endpoint needs an identifier and a secret that are reported for the same scope.

A scope never leaves a text, so the join is done where the text is: identifiers are met in
order, other parts by binary search of their sorted positions. Nothing is shuffled, and no
pairs are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common

#: Kinds in the order in which equal starts are listed; the first three are the strong ones.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]
RADIUS = 240
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long,scope:long>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([
            ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("scope", pa.int64()),
        ]))),
    ]
)

# The base patterns and their least lengths.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

_WEAK_ID = re.compile(
    r"""(?:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9_.@-]{4,})""",
    re.IGNORECASE | re.ASCII,
)
_WEAK_ID_WORDS = (
    "clientid", "client_id", "keyid", "key_id", "accountid", "account_id", "username",
    "user_name", "login",
)
_WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}""")
_BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int, int]


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Strong findings as ``(kind, start, end)``: leftmost, non-overlapping for each kind."""
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= LEAST_ACCESS:
                yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _mixed(token: str) -> bool:
    """Whether a token looks drawn at random: capital and small letters and digits."""
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token))


def _reaching(parts: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Parts, sorted and without overlaps, that share a character with an interval."""
    at = bisect_left(parts, (low, 0))
    if at and parts[at - 1][1] > low:
        at -= 1
    found = []
    while at < len(parts) and parts[at][0] < high:
        found.append(parts[at])
        at += 1
    return found


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans cover together, as sorted intervals apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _overlap(span: tuple[int, int], taken: list[tuple[int, int]]) -> bool:
    """Whether a span shares a character with any of sorted, disjoint intervals."""
    at = bisect_left(taken, (span[1], 0))
    return at > 0 and taken[at - 1][1] > span[0]


def linked_spans(text: str, strong: list[tuple[str, int, int]], radius: int = RADIUS) -> list[Span]:
    """Weak candidates with their complementary parts, as ``(kind, start, end, scope start)``."""
    lower = text.lower()
    taken = _disjoint([(a, b) for _, a, b in strong])
    identifiers = [(a, b, True) for kind, a, b in strong if kind == "access"]
    if any(word in lower for word in _WEAK_ID_WORDS):
        identifiers += [
            (m.start(), m.end(), False) for m in _WEAK_ID.finditer(text)
            if not _overlap(m.span(), taken)
        ]
    if not identifiers:
        return []
    identifiers.sort()
    names = [(a, b) for a, b, is_strong in identifiers if not is_strong]
    # Each kind by itself, as a hexadecimal run may lie in an assignment.
    secrets = [[(a, b) for kind, a, b in strong if kind == own] for own in ("assign", "hex")]
    endpoints = [m.span() for m in _ENDPOINT.finditer(text)]
    weak = [
        m.span() for m in _WEAK_SECRET.finditer(text)
        if _mixed(m[0]) and not _overlap(m.span(), taken) and not _overlap(m.span(), names)
        and not _overlap(m.span(), endpoints)
    ]
    breaks = [m.start() for m in _BLANK_LINE.finditer(text)]
    out: dict[tuple[str, int, int], int] = {}
    for a, b, is_strong in identifiers:
        at = bisect_left(breaks, a)
        low = max(a - radius, breaks[at - 1] if at else 0, 0)
        after = bisect_left(breaks, b)
        high = min(b + radius, breaks[after] if after < len(breaks) else len(text))
        near_secrets = any(_reaching(some, low, high) for some in secrets)
        near_weak, near_ends = _reaching(weak, low, high), _reaching(endpoints, low, high)
        if is_strong or near_ends:
            for x, y in near_weak:
                out.setdefault(("weak_secret", x, y), low)
            linked = near_secrets or bool(near_weak)
        else:
            linked = near_secrets
        if linked:
            if not is_strong:
                out.setdefault(("weak_id", a, b), low)
            for x, y in near_ends:
                out.setdefault(("endpoint", x, y), low)
    return [(*span, scope) for span, scope in out.items()]


def scan_text(text: str, radius: int = RADIUS) -> list[Span]:
    """All spans of a text by start, then kind; ``scope`` is -1 for strong findings."""
    strong = list(base_spans(text))
    spans = [(*s, -1) for s in strong] + linked_spans(text, strong, radius)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(
    docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, spans`` of every row; positions are code points, ends exclusive.

    A null or empty text has no spans. Null ids stay, repeated rows are scanned each, other
    columns are left behind, an empty table gives no rows.
    """

    def run(batches):
        made = (
            (doc_id, [dict(zip(("kind", "start", "stop", "scope"), s)) for s in scan_text(text, radius)])
            for doc_id, text in common.rows_of(batches)
        )
        yield from common.batched(made, _ARROW)

    return common.texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )

"""Secret scans: base patterns, and multipart credentials linked by an interval join of their parts.

Base spans stand on their own. Weak parts - short or unnamed secrets, account names, endpoints - are common in clean
text, so one is reported only when a complementary part lies in the same scope: scopes are the stretches between blank
lines, and parts join when they lie within the same scope. A secret needs an
identifier or an endpoint; an identifier or an endpoint needs a secret. The join is a sweep over the parts in order of
their start, in memory in proportion to one text.

Defined results: a null text counts as empty; an empty text has no spans and the hash of the empty string; places are
code points, ends exclusive; rows that repeat an id are scanned each; an empty table gives no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint")
LEAST_WEAK, LEAST_UNNAMED, LEAST_ENTROPY = 6, 20, 3.5
#: Every run that can hold an access, hex or unnamed part is at least this long.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_IDENTIFIER = re.compile(r"""(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,})""", re.IGNORECASE | re.ASCII)
_IDENTIFIER_WORDS = (b"user", b"login", b"account", b"client", b"access")
_ENDPOINT_WORDS = (b"://", b"host", b"endpoint", b"server", b"url")
_BREAK = re.compile(r"\n[ \t\r]*\n")
_ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "identifier": "id", "endpoint": "end"}


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def base_spans(text: str, lowered: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans (start, end, kind), and weak secrets that the same passes meet."""
    base, weak = [], []
    if any(x in lowered for x in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                base.append((*m.span(), "assign"))
            elif len(m[2]) >= LEAST_WEAK:
                weak.append((*m.span(), "weak_secret"))
    for run in _RUN.finditer(text):
        low, high = run.span()
        found = [(*m.span(), "access") for m in ACCESS.finditer(text, low, high) if m.end() - m.start() >= LEAST_ACCESS]
        found += [(*m.span(), "hex") for m in HEX.finditer(text, low, high) if m.end() - m.start() >= LEAST_HEX]
        base += found
        part = run[0]
        if not found and len(part) >= LEAST_UNNAMED and any(c.isdigit() for c in part) and any(c.isupper() for c in part) and any(c.islower() for c in part) and _entropy(part) >= LEAST_ENTROPY:
            weak.append((low, high, "weak_secret"))
    return base, weak


def linked_parts(text: str, parts: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Pairs of numbers of complementary parts of one scope, by two sweeps over the parts' starts.

    The first joins each part with the nearest earlier part of each complementary role, the second with the nearest
    later one: a part that has a complement anywhere in its scope gets a link, without listing all pairs of a scope.
    """
    breaks = [m.start() for m in _BREAK.finditer(text)] if parts else []
    order = sorted(range(len(parts)), key=lambda i: parts[i])
    scope_of = {i: bisect.bisect_right(breaks, parts[i][0]) for i in order}
    links: set[tuple[int, int]] = set()
    for backward in (False, True):
        nearest: dict[str, int] = {}
        scope = -1
        for i in reversed(order) if backward else order:
            start, end, kind = parts[i]
            if scope_of[i] != scope:
                scope, nearest = scope_of[i], {}
            role = _ROLE[kind]
            for other, j in nearest.items():
                if other != role and "secret" in (other, role):
                    links.add((i, j) if backward else (j, i))
            if backward or role not in nearest or parts[nearest[role]][1] < end:
                nearest[role] = i
    return sorted(links)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Base spans, all spans (both by start, then kind), and links as places in all spans."""
    lowered = text.encode("utf-8", "surrogatepass").lower()
    base, weak = base_spans(text, lowered)
    order = lambda spans: sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    parts = base + [x for x in weak if not any(x[0] < b[1] and b[0] < x[1] for b in base)]
    if parts:
        if any(x in lowered for x in _IDENTIFIER_WORDS):
            parts += [(*m.span(), "identifier") for m in _IDENTIFIER.finditer(text)]
        if any(x in lowered for x in _ENDPOINT_WORDS):
            parts += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    links = linked_parts(text, parts)
    joined = {i for pair in links for i in pair}
    every = order(base + [parts[i] for i in joined])
    place = {x: i for i, x in enumerate(every)}
    return order(base), every, sorted((place[parts[i]], place[parts[j]]) for i, j in links)


def _scans(batches):
    for batch in batches:
        spans, bases, links = [], [], []
        for text in batch.column(1).to_pylist():
            base, every, linked = scan(text or "")
            bases.append([f"{k}:{s}:{e}" for s, e, k in base])
            spans.append([f"{k}:{s}:{e}" for s, e, k in every])
            links.append([f"{i}-{j}" for i, j in linked])
        strings = pa.list_(pa.string())
        yield pa.record_batch({"doc_id": batch.column(0), "base_spans": pa.array(bases, strings), "spans": pa.array(spans, strings), "links": pa.array(links, strings)})


def scan_secrets(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, base_spans, spans (each kind:start:end) and links (pairs of places in spans)."""
    ship(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_scans, "doc_id bigint, base_spans array<string>, spans array<string>, links array<string>")

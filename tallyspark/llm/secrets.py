"""Secret scan (operator 2): fixed formats, and sliding-window entropy over candidate strings.

``scan`` returns for every row its spans; the base formats are exact regular expressions, and the
method adds spans of kind ``entropy``: in every candidate string a window slides over the characters,
the counts of the characters of each class (hex, alphanumeric, base64) are kept by adding the
entering and removing the leaving one, and the string is reported where the entropy of a window
over a class that covers it reaches the threshold of that class. An allow list suppresses strings
that look random but aren't secret.

Defined results: a null text is an empty one; empty texts have no spans; rows are independent, so ties,
repeated rows and an empty table need nothing; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base formats.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of characters from which secrets are made; every access key and long hex string lies in one.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"

CLASSES = {
    "hex": frozenset("0123456789abcdefABCDEF"),
    "alnum": frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base64": frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"),
}


@dataclass(frozen=True)
class EntropyRule:
    """window: characters looked at together; thresholds: bits for each class."""

    window: int = 20
    hex_bits: float = 2.9
    alnum_bits: float = 3.7
    base64_bits: float = 3.8

    def bits(self, name: str) -> float:
        return {"hex": self.hex_bits, "alnum": self.alnum_bits, "base64": self.base64_bits}[name]


#: A path segment of words and numbers: letters with a few digits behind them, or digits with a letter before them at most.
WORDS = r"(?:(?:[A-Za-z]{2,}[0-9]{0,4}|[A-Za-z]?[0-9]+|[A-Za-z])(?:[-_.=+]+|(?=/|\Z)))+"
SEGMENT = re.compile(rf"[-_.=+]*{WORDS}\Z")
#: A host name with a dot, as a URL's candidate begins after its colon, or without scheme.
HOST = r"(?://)?(?:[A-Za-z0-9_-]+\.)+[a-z]{2,}(?=/|\Z)"
URL = re.compile(HOST)

#: Strings that are never reported by entropy alone: identifiers, numbers, host names, paths, file names, versions, words.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z",
        r"[0-9.+/_=-]+\Z",
        r"[A-Za-z.+/_=-]+\Z",
        rf"{HOST}(?:/+{WORDS})*/*\Z",
        rf"/{{1,2}}{WORDS}(?:/+{WORDS})*/*\Z",
        r"[\w.-]+\.(?:html?|json|xml|png|jpe?g|gif|svg|css|js|py|txt|pdf|zip|gz)\Z",
        r"v?[0-9]+(?:\.[0-9]+){1,3}(?:[-_.]?[a-z][0-9]{0,8})*\Z",  # a suffix as in 2.0-rc1.post2: one letter at a time, so that each text has one way to match
        r"(?:[A-Za-z]+[0-9]{0,4}[-_./=+]+)+[A-Za-z]*[0-9]{0,4}\Z",
    )
)


def allowed(text: str) -> bool:
    """Whether the allow list suppresses ``text``; a string of few different characters also is no secret."""
    return len(set(text)) < 8 or any(p.match(text) for p in ALLOWED)


def scored(text: str) -> list[tuple[int, int]]:
    """The parts of a candidate that are scored: the long segments of a URL or path, each on its own, or else the whole.

    A slash is also a letter of base64, so what has no host is a path only if most of its segments are words.
    """
    parts = [m.span() for m in re.finditer(r"[^/]+", text)]
    if "/" in text and (URL.match(text) or text[0] == "/" and 2 * sum(bool(SEGMENT.match(text[a:b])) for a, b in parts) > len(parts)):
        return [(a, b) for a, b in parts if b - a >= 20]
    return [(0, len(text))]


def window_entropies(text: str, rule: EntropyRule) -> dict[str, float]:
    """For each class that covers some whole window, the highest Shannon entropy (bits) of such a window.

    Counts change by one entering and one leaving character a step, and so does the sum of c log2 c.
    """
    n = min(rule.window, len(text))
    best: dict[str, float] = {}
    if not n:
        return best
    gain = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    for name, members in CLASSES.items():
        counts: dict[str, int] = {}
        inside, total, high = 0, 0.0, -1.0
        for i, ch in enumerate(text):
            if ch in members:
                c = counts.get(ch, 0)
                total += gain[c + 1] - gain[c]
                counts[ch] = c + 1
                inside += 1
            if i >= n and (old := text[i - n]) in members:
                c = counts[old]
                total += gain[c - 1] - gain[c]
                counts[old] = c - 1
                inside -= 1
            if i >= n - 1 and inside == n:
                high = max(high, math.log2(n) - total / n)
        if high >= 0:
            best[name] = high
    return best


def is_secret(text: str, rule: EntropyRule) -> bool:
    """Whether a candidate is reported: not allow-listed (which strings of letters or digits alone are), and a window of enough entropy."""
    if allowed(text):
        return False
    return any(bits >= rule.bits(name) for name, bits in window_entropies(text, rule).items())


def spans_of(text: str, rule: EntropyRule) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), ordered by start and then kind."""
    out: list[tuple[int, int, int]] = []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for a, b in runs:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        out += [(*m.span(), 2) for m in HEX.finditer(text, a, b)]
    starts: list[int] = []  # base spans, those that overlap joined: both lists ascend
    ends: list[int] = []
    for s, e, _ in sorted(out):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for lo, hi in runs:
        for a, b in ((lo + x, lo + y) for x, y in scored(text[lo:hi])):
            i = bisect_left(starts, b)  # the last span that starts before the end
            if not (i and ends[i - 1] > a) and is_secret(text[a:b], rule):
                out.append((a, b, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def _scan(batches: Iterable[pa.RecordBatch], rule: EntropyRule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = spans_of(text.as_py() or "", rule)
            named = [f"{k}:{s}:{e}" for s, e, k in found]
            base = [x for x, (_, _, k) in zip(named, found, strict=True) if k != "entropy"]
            rows["doc_id"].append(doc_id)
            for kind in KINDS:
                rows[f"n_{kind}"].append(sum(k == kind for _, _, k in found))
            rows["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
            rows["spans"].append(",".join(named))
        yield pa.RecordBatch.from_pydict(rows)


def scan(docs: DataFrame, rule: EntropyRule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts for each kind, a digest of the base spans, and all spans as text."""
    rule = rule or EntropyRule()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scan(batches, rule), SCHEMA)

"""URL filters (operator 12): glob rules as one bit-parallel automaton.

All rules are packed into the bits of a row of 64-bit words, a bit for each place in a rule, and run together over each canonical URL (Shift-And): a character moves
every place on by one shift, keeps those that the character's mask allows, and lets the places before a star stay. A batch's URLs advance
side by side, longest first, so that a step is a few array operations on those that still have characters.

Globs: ``*`` is any text without a slash, ``**`` any text, ``?`` one character but a slash, ``[abc]``, ``[a-z]`` and ``[!a]`` one of a set; all else is itself. A glob
matches a whole canonical URL: the host with A-Z in lower case, the path, and ``?`` with the query, if there is one; scheme and fragment are left out.

A host rule (``example.net/en/``) stands for its host and all subdomains and every path that starts with its own: two globs. Among host rules that fit, the longest wins; of
equally long ones that block, then the first by code point. Where no host rule fits, the longest fitting glob decides, by the same order; where none fits, the URL is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path and an empty canonical form, which only globs of stars fit; rows are independent, so
repeated rows need nothing; an empty table gives no rows; null ids stay; other columns aren't read; an empty rule set allows everything.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; pattern: a host with a path, or a glob over the canonical URL."""

    verdict: str
    pattern: str


# The rules of hosts and paths.
HOST_RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
#: The globs that judge all other URLs: a choice of names and paths under which there is no text to learn from.
GLOBS = (
    Rule("block", "*cheap-pills*/**"), Rule("block", "*casino*/**"), Rule("block", "spam-*/**"), Rule("block", "*.spam-*/**"), Rule("block", "adserv*.*/**"),
    Rule("block", "**/wp-login*"), Rule("block", "**/wp-admin/**"), Rule("block", "**/cart/**"), Rule("block", "**[?&]sessionid=**"),
    Rule("block", "**.exe"), Rule("block", "**.zip"), Rule("block", "**.jp[eg]*"), Rule("block", "**.png"),
)
_ORDINARY = 128


def tokens(glob: str) -> tuple[list[tuple[str, object]], list[int]]:
    """A glob's single-character tests, and for each place between them (0 before the first) the star there: 0 none, 1 within a segment, 2 any."""
    tests: list[tuple[str, object]] = []
    stars = [0]
    for m in re.finditer(r"\*+|\[(!?)([^\]]+)\]|.", glob, re.S):
        part = m[0]
        if part[0] == "*":
            stars[-1] = max(stars[-1], min(2, len(part)))
            continue
        if part == "?":
            tests.append(("not", frozenset("/")))
        elif m[2]:
            members: set[str] = set()
            for r in re.finditer(r"(.)-(.)|.", m[2], re.S):
                members |= {chr(c) for c in range(ord(r[1]), ord(r[2]) + 1)} if r[1] else {r[0]}
            tests.append(("not" if m[1] else "in", frozenset(members)))
        else:
            tests.append(("in", frozenset(part)))
        stars.append(0)
    return tests, stars


class Automaton:
    """Masks of all globs, over the characters below 128 and those others that a glob names; a last column stands for all the rest."""

    def __init__(self, globs: Sequence[str]):
        parsed = [tokens(g) for g in globs]
        extra = sorted({c for tests, _ in parsed for _, members in tests for c in members if ord(c) >= _ORDINARY})
        self.extra = np.array([ord(c) for c in extra], np.int64)
        letters = [chr(c) for c in range(_ORDINARY)] + extra + [None]
        size = sum(len(s) for _, s in parsed)
        width = max(1, -(-size // 64))
        moves, stays = np.zeros((len(letters), width), np.uint64), np.zeros((len(letters), width), np.uint64)
        self.start = np.zeros(width, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for tests, stars in parsed:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for place, star in enumerate(stars):
                word, bit = (at + place) // 64, np.uint64(1 << (at + place) % 64)
                for i, c in enumerate(letters):
                    if star == 2 or star == 1 and c != "/":
                        stays[i, word] |= bit
                    if place:
                        kind, members = tests[place - 1]
                        if (c in members) == (kind == "in"):
                            moves[i, word] |= bit
            end = at + len(stars) - 1
            self.ends.append((end // 64, np.uint64(1 << end % 64)))
            at += len(stars)
        self.moves, self.stays = moves, stays

    def columns(self, text: str) -> np.ndarray:
        """The characters of a text as rows of the masks."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        high = codes >= _ORDINARY
        if high.any():
            if len(self.extra):
                place = np.minimum(np.searchsorted(self.extra, codes), len(self.extra) - 1)
                codes = np.where(high, np.where(self.extra[place] == codes, _ORDINARY + place, _ORDINARY + len(self.extra)), codes)
            else:
                codes = np.where(high, _ORDINARY, codes)
        return codes

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, globs): which globs match which whole texts."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        codes = np.concatenate([self.columns(texts[i]) for i in order]) if order else np.zeros(0, np.int64)
        state = np.tile(self.start, (len(texts), 1))
        left = len(order)
        for step in range(int(lengths[0]) if left else 0):
            while lengths[left - 1] <= step:
                left -= 1
            c = codes[starts[:left] + step]
            now = state[:left]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:left] = moved & self.moves[c] | now & self.stays[c]
        found = np.zeros((len(texts), len(self.ends)), bool)
        for g, (word, bit) in enumerate(self.ends):
            found[order, g] = (state[:, word] & bit) != 0
        return found


def _preference(rules: Sequence[Rule]) -> list[Rule]:
    """The rules, those that win first."""
    return sorted(set(rules), key=lambda r: (-len(r.pattern), r.verdict != "block", r.pattern))


def _judge(hosts: Sequence[Rule], globs: Sequence[Rule], rows: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hosts, globs = _preference(hosts), _preference(globs)
    literal = {c: f"[{c}]" for c in "*?["}
    texts = [lead + "".join(literal.get(c, c) for c in r.pattern) + "**" for r in hosts for lead in ("", "*.")] + [r.pattern for r in globs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(texts)
        for whole in batches:
            for lo in range(0, len(whole), rows):
                batch = whole.slice(lo, rows)
                found = machine.matches(batch.column(3).to_pylist())
                split = 2 * len(hosts)
                by_host = found[:, :split:2] | found[:, 1:split:2]
                out: dict[str, list] = {"rule": [], "glob": [], "verdict": []}
                for own, other in zip(by_host, found[:, split:], strict=True):
                    rule = hosts[int(own.argmax())] if own.any() else None
                    glob = globs[int(other.argmax())] if other.any() else None
                    out["rule"].append(rule and rule.pattern)
                    out["glob"].append(glob and glob.pattern)
                    out["verdict"].append((rule or glob or Rule("allow", "")).verdict)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v, pa.string()) for v in out.values())], ["page_id", "host", "path", *out])

    return run


def judge(pages: DataFrame, hosts: Sequence[Rule] = HOST_RULES, globs: Sequence[Rule] = GLOBS, id_col: str = "page_id", url_col: str = "url", rows: int = 2_048) -> DataFrame:
    """page_id, host, path, rule, glob and verdict of every row; ``rows`` URLs advance side by side."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    behind = F.expr("substring(rest, length(authority) + 1)")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), rest.alias("rest")).withColumn("authority", F.regexp_extract("rest", r"^[^/?#]*", 0)).withColumn("behind", behind)
    parts = parts.select(
        "page_id", F.translate("authority", upper, upper.lower()).alias("host"), F.regexp_extract("behind", r"^[^?#]*", 0).alias("path"), F.regexp_extract("behind", r"^[^?#]*(\?[^#]*)?", 1).alias("query")
    )
    shaped = parts.select("page_id", "host", "path", F.concat("host", "path", "query").alias("canonical"))
    return shaped.mapInArrow(_judge(hosts, globs, rows), "page_id long, host string, path string, rule string, glob string, verdict string")


#: The host rules as plain conditions and the globs as regular expressions, written by hand.
ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS a, rest FROM r),
p AS (SELECT page_id, translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(a) + 1), '^[^?#]*') AS path,
  split_part(substr(rest, length(a) + 1), '#', 1) AS tail FROM h),
m AS (SELECT page_id, host, path, host || tail AS c, '.' || host AS d FROM p),
f AS (SELECT page_id, host, path, CASE WHEN d LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/' WHEN d LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN d LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN d LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE WHEN regexp_full_match(c, '(?s).*[?&]sessionid=.*') THEN '**[?&]sessionid=**' WHEN regexp_full_match(c, '(?s)[^/]*cheap-pills[^/]*/.*') THEN '*cheap-pills*/**' WHEN regexp_full_match(c, '(?s).*/wp-admin/.*') THEN '**/wp-admin/**'
    WHEN regexp_full_match(c, '(?s).*/wp-login[^/]*') THEN '**/wp-login*' WHEN regexp_full_match(c, '(?s)adserv[^/]*\\.[^/]*/.*') THEN 'adserv*.*/**' WHEN regexp_full_match(c, '(?s)[^/]*\\.spam-[^/]*/.*') THEN '*.spam-*/**'
    WHEN regexp_full_match(c, '(?s)[^/]*casino[^/]*/.*') THEN '*casino*/**' WHEN regexp_full_match(c, '(?s).*\\.jp[eg][^/]*') THEN '**.jp[eg]*' WHEN regexp_full_match(c, '(?s).*/cart/.*') THEN '**/cart/**'
    WHEN regexp_full_match(c, '(?s)spam-[^/]*/.*') THEN 'spam-*/**' WHEN regexp_full_match(c, '(?s).*\\.exe') THEN '**.exe' WHEN regexp_full_match(c, '(?s).*\\.png') THEN '**.png' WHEN regexp_full_match(c, '(?s).*\\.zip') THEN '**.zip' END AS "glob" FROM m)
SELECT page_id, host, path, rule, "glob", CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN "glob" IS NULL THEN 'allow' ELSE 'block' END END AS verdict FROM f
"""

"""Page payloads that refer to their own values by position: a flat array in a script, back to nested JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The script that holds the array; references below zero, by what JSON can say of them (not-a-numbers and infinities are null); tags that only wrap a value; tags of mappings.
SCRIPT = r'(?s)<script\b[^>]*\bid="__NUXT_DATA__"[^>]*>(.*?)</script>'
ABSENT = (-1, -7)
SPECIAL = {-2: None, -3: None, -4: None, -5: None, -6: 0}
WRAPPERS = frozenset(("Reactive", "ShallowReactive", "Ref", "ShallowRef", "Object"))
MAPPING, BARE_MAPPING, COLLECTION = "Map", "null", "Set"
#: Longest result, in characters: values that many places share are written out in each, which a page can be made to abuse. A longer one is null.
MOST_CHARACTERS = 64_000_000

_MISSING = object()


def _plan(cells: list, index: Any) -> tuple[str, list]:
    """What a cell becomes: ("value", [json]), ("same", [reference]), ("list", references), ("dict", (key or reference, reference) pairs) or ("absent", [])."""
    if isinstance(index, bool) or not isinstance(index, int) or index >= len(cells) or index in ABSENT or index < -7:
        return "absent", []
    if index < 0:
        return "value", [SPECIAL[index]]
    cell = cells[index]
    if isinstance(cell, dict):
        return "dict", [(k, v) for k, v in cell.items() if k != "__proto__"]
    if not isinstance(cell, list):
        return "value", [None if isinstance(cell, float) and not math.isfinite(cell) else cell]
    if not cell or not isinstance(cell[0], str):
        return "list", cell
    tag, rest = cell[0], cell[1:]
    if tag in WRAPPERS:
        return "same", rest[:1] or [-1]
    if tag == COLLECTION:
        return "list", rest
    if tag in (MAPPING, BARE_MAPPING):
        named = [(cells[k] if tag == MAPPING and isinstance(k, int) and not isinstance(k, bool) and 0 <= k < len(cells) else k, v) for k, v in zip(rest[::2], rest[1::2], strict=False)]
        return "dict", [(k, v) for k, v in named if isinstance(k, str) and k != "__proto__"]
    return ("value", rest[:1]) if rest and isinstance(rest[0], str) else ("absent", [])


def hydrate(text: str | None, most: int = MOST_CHARACTERS) -> str | None:
    """The nested JSON of a flat array; null for what is no such array, or is longer than ``most``.

    Cells are finished children first, on a stack of our own, each once: its text serves all that refer to it. A cell that refers to itself through others is null there. What is absent
    has no member in an object and is null in a list.
    """
    try:
        cells = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(cells, list) or not cells:
        return None
    done: dict[int, Any] = {}
    open_now: set[int] = set()
    stack = [0]

    def known(ref: Any) -> Any:
        if not isinstance(ref, int) or isinstance(ref, bool) or ref < 0:
            kind, parts = _plan(cells, ref)
            return json.dumps(parts[0]) if kind == "value" else _MISSING
        return done.get(ref, "null" if ref in open_now else _MISSING)

    while stack:
        at = stack[-1]
        if at in done:
            stack.pop()
            continue
        kind, parts = _plan(cells, at)
        refs = [v for _, v in parts] if kind == "dict" else parts if kind in ("list", "same") else []
        waiting = [r for r in refs if isinstance(r, int) and not isinstance(r, bool) and 0 <= r < len(cells) and r not in done and r not in open_now and r != at]
        if waiting and at not in open_now:
            open_now.add(at)
            stack += reversed(waiting)
            continue
        open_now.add(at)
        if kind == "value":
            found: Any = json.dumps(parts[0], ensure_ascii=False)
        elif kind == "same":
            found = known(parts[0])
        elif kind == "list":
            found = "[" + ",".join("null" if v is _MISSING else v for v in map(known, parts)) + "]"
        elif kind == "dict":
            members = {k: v for k, v in ((k, known(r)) for k, r in parts) if v is not _MISSING}
            found = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in members.items()) + "}"
        else:
            found = _MISSING
        if found is not _MISSING and len(found) > most:
            return None
        done[at] = found
        open_now.discard(at)
        stack.pop()
    return None if done[0] is _MISSING else done[0]


def hydrated(x: Column) -> Column:
    """JSON text of a flat payload's value; a row's work is its own, so nothing is shuffled."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([hydrate(v) for v in batch], dtype=object)

    return run(x)


def page_payload(html: Column) -> Column:
    """The hydrated payload that a page's script holds, or null."""
    return hydrated(F.nullif(F.regexp_extract(html, SCRIPT, 1), F.lit("")))

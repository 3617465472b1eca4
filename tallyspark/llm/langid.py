"""Language identification (operator 6) by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text answers which strings
occur in it. A text is parsed greedily into the longest phrases that occur; the fewer phrases a
letter needs, each costing the bits that name a place in the sample, the likelier the language. Automata are laid out as
one dense table whose entries also tell where a phrase ended, so that all blocks of many texts step together.
Texts are parsed whole; one of over ``BLOCK`` symbols in consecutive blocks, each of which starts a new phrase: at most one phrase more in some
thousand, alike for all languages.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to the smaller language;
with no labelled row every text is ``und``; repeated rows change nothing but the sample; the sample is the rows with the
smallest hash of doc_id for each language, so reruns agree; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.memory import give_back, held

#: Symbols of a long text that are parsed side by side with its other blocks; results don't depend on it.
BLOCK = 4096
#: Symbols of text handled at once by a worker; a longer text is handled alone.
SLICE = 1_500_000
#: Pieces of a language's labelled rows, of each of which the sample's candidates are picked first.
PIECES = 64


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned from: documents for each language, letters of each, and different letters that a language keeps apart.

    A language's sample has at most documents * letters symbols; only a script of over ``alphabet`` letters takes some as one.
    """

    documents: int = 240
    letters: int = 128
    alphabet: int = 250


def normalise(text: str) -> str:
    """Lower-case letters, and one space for each run of anything else."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``symbols``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


class CrossParser:
    """Counts phrases of texts against every language at once."""

    def __init__(self, texts: dict[str, str], alphabet: int):
        self.languages = sorted(texts)
        known = sorted({c for t in texts.values() for c in t if c != " "})
        #: Every letter's place among those of all samples: 0 for what is no letter, the last for a letter that no sample has.
        self.places = self._place_table({c: i + 1 for i, c in enumerate(known)})
        #: By language and place, the symbol of the letter in that language's automaton.
        self.symbols = np.zeros((len(texts), len(known) + 2), np.uint8)
        tables, self.bits, roots, base = [], [], [], 0
        for k, name in enumerate(self.languages):
            letters = Counter(c for c in texts[name] if c != " ")
            code = {c: i + 1 for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:alphabet])}
            other = len(code) + 1
            self.symbols[k] = [0, *(code.get(c, other) for c in known), other]
            moves = suffix_automaton([0 if c == " " else code.get(c, other) for c in texts[name]])
            tables.append(self._table(moves, base, other + 1))
            roots.append(base)
            self.bits.append(math.log2(len(texts[name]) + 2))
            base += len(tables[-1])
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)[:, None]

    @staticmethod
    def _place_table(place: dict[str, int]) -> np.ndarray:
        table = np.zeros(0x110000, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = place.get(c.lower()[0], len(place) + 1)
        return table

    @staticmethod
    def _table(moves: list[dict[int, int]], base: int, a: int) -> np.ndarray:
        """Rows of twice the place of the next state's row, plus one where a phrase ends before the symbol; ``a`` symbols a row.

        A symbol that the sample lacks is a phrase of its own: it leads to a last state, which every symbol leaves by a new phrase.
        """
        lost = len(moves)
        fresh = np.array([2 * (base + moves[0].get(c, lost) * a) + 1 for c in range(a)], np.int32)
        table = np.tile(fresh, (lost + 1, 1))
        table[0] -= 1  # a text's first symbol ends nothing
        for s, row in enumerate(moves):
            for c, to in row.items():
                table[s, c] = 2 * (base + to * a)
        return table.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by language and text, letters by text)."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.places[points]
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
        keep = codes != 0
        letters = np.bincount(owner[keep], minlength=n)
        keep[1:] |= (codes[:-1] != 0) & (owner[1:] == owner[:-1])
        codes, owner = codes[keep], owner[keep]
        sizes = np.bincount(owner, minlength=n)
        starts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[of] + nth * BLOCK
        long = np.minimum(sizes[of] - nth * BLOCK, BLOCK)
        order = np.argsort(-long, kind="stable")
        begin, long, of = begin[order], long[order], of[order]
        counts = np.zeros((len(self.languages), len(of)), np.int32)
        state = np.repeat(self.roots, len(of), axis=1)
        active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")
        table, symbols = self.table, self.symbols
        for t, m in enumerate(active):
            went = table[state[:, :m] + symbols[:, codes[begin[:m] + t]]]
            counts[:, :m] += went & 1
            state[:, :m] = went >> 1
        self._carry(codes, begin, long, of, nth[order], counts, state)
        counts[:, nth[order] == 0] += 1  # a text's last phrase ends with it
        total = np.zeros((len(self.languages), n), np.int64)
        for row, got in zip(total, counts, strict=True):
            np.add.at(row, of, got)
        return total, letters

    def _carry(self, codes: np.ndarray, begin: np.ndarray, long: np.ndarray, of: np.ndarray, nth: np.ndarray, counts: np.ndarray, state: np.ndarray) -> None:
        """Mends ``counts`` and end states of blocks, all parsed from the start, to those of a parse that comes out of the block before.

        Both parses run side by side from a block's first symbol until they meet, soon as a rule; from there on they are one. A block in which they never meet ends elsewhere, and
        the block behind it is looked at again.
        """
        place = {(int(d), int(k)): i for i, (d, k) in enumerate(zip(of, nth, strict=True))}
        before = {i: place[d, k - 1] for (d, k), i in place.items() if k}
        after = {p: i for i, p in before.items()}
        came = np.repeat(self.roots, len(of), axis=1)  # the states from which each block has been parsed
        todo = np.array(sorted(before), np.int64)
        while len(todo):
            own, other = state[:, [before[i] for i in todo.tolist()]].copy(), came[:, todo].copy()
            came[:, todo] = own
            start, end = own != other, long[todo]
            apart = start.copy()
            for t in range(int(end.max())):
                cols = np.flatnonzero(apart.any(axis=0) & (t < end))
                if not len(cols):
                    break
                symbol = self.symbols[:, codes[begin[todo[cols]] + t]]
                new, old = self.table[own[:, cols] + symbol], self.table[other[:, cols] + symbol]
                live = apart[:, cols]
                counts[:, todo[cols]] += np.where(live, (new & 1) - (old & 1), 0)
                own[:, cols], other[:, cols] = np.where(live, new >> 1, own[:, cols]), np.where(live, old >> 1, other[:, cols])
                apart[:, cols] &= own[:, cols] != other[:, cols]
            lost = np.flatnonzero(apart.any(axis=0))
            for c in lost:
                state[:, todo[c]] = np.where(apart[:, c], own[:, c], state[:, todo[c]])
            todo = np.array(sorted(after[i] for i in todo[lost].tolist() if i in after), np.int64)

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, phrase bits a letter) of every text; score is the runner-up's relative loss."""
        if not self.languages:
            return [("und", 0.0, 0.0)] * len(texts)
        total, letters = self.phrases(texts)
        cost = total * np.array(self.bits)[:, None] / np.maximum(letters, 1)
        best = cost.argmin(axis=0)
        low = cost.min(axis=0)
        second = np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, 1 - low / np.maximum(second, 1e-9)).clip(0, 1)
        return [("und", 0.0, 0.0) if not k else (self.languages[b], float(s), float(v)) for k, b, s, v in zip(letters, best, score, low, strict=True)]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample: Sample | None = None) -> dict[str, str]:
    """Normalised sample text for each language, from labelled rows that aren't held out; bounded by ``sample`` for each language."""
    sample = sample or Sample()
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(PIECES)))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = Window.partitionBy("lang", "piece").orderBy(*order)  # a language's rows meet in PIECES tasks, and only their first ones in one
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample.documents)
    picked = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("nth") <= sample.documents)
    ids = {(r["doc_id"], r["lang"]) for r in picked.select("doc_id", "lang").collect()}
    if not ids:
        return {}
    # As few rows as the bound allows: a literal list, so that only the matching row groups' texts are read; repeated ids give one text a language.
    letters = F.substring(F.trim(F.regexp_replace(F.col("text").cast("string"), r"[^\p{L}]+", " ")), 1, 2 * sample.letters)
    found = docs.where(F.col("doc_id").isin(sorted({i for i, _ in ids}))).select("doc_id", F.col("lang").cast("string").alias("lang"), letters.alias("text"))
    found = found.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    parts: dict[str, list[str]] = {}
    for r in sorted({(r["doc_id"], r["lang"], r["text"]) for r in found.collect() if r["text"] is not None and (r["doc_id"], r["lang"]) in ids}):
        if text := normalise(r[2])[: sample.letters]:
            parts.setdefault(r[1], []).append(text)
    return {name: " ".join(texts) for name, texts in parts.items()}


def _key(texts: dict[str, str]) -> str:
    return hashlib.sha256(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).hexdigest()


def _parser(key: str, texts: dict[str, str], alphabet: int) -> CrossParser:
    """One parser for each worker process and model, built where it is used."""
    return held(("langid", key, alphabet), lambda: CrossParser(texts, alphabet))


def _slices(texts: Iterable[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _identify(batches: Iterable[pa.RecordBatch], model, key: str, alphabet: int) -> Iterator[pa.RecordBatch]:
    parser = _parser(key, model.value, alphabet)
    for batch in batches:
        got: list[tuple[str, float, float]] = []
        for part in _slices(t.as_py() or "" for t in batch.column(1)):
            got += parser.predict(part)
        langs, scores, costs = ([x[i] for x in got] for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(costs, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score", "bits_per_letter"],
        )
    give_back()


def identify(docs: DataFrame, sample: Sample | None = None) -> DataFrame:
    """For every row: doc_id, held_out, lang_pred, score (0 to 1) and bits_per_letter, the cost of the best parse."""
    sample = sample or Sample()
    texts = learn(docs, sample)
    model = docs.sparkSession.sparkContext.broadcast(texts)  # at most sample.documents * sample.letters symbols a language
    key, alphabet = _key(texts), sample.alphabet
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_letter double"
    return rows.mapInArrow(lambda batches: _identify(batches, model, key, alphabet), schema)


def keep_identified(docs: DataFrame, most_bits: float = 10.0, sample: Sample | None = None) -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letters, or a parse that costs over ``most_bits`` a letter."""
    sample = sample or Sample()
    texts = learn(docs, sample)
    model = docs.sparkSession.sparkContext.broadcast(texts)
    key, alphabet, schema = _key(texts), sample.alphabet, docs.schema
    at = schema.fieldNames().index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(key, model.value, alphabet)
        for batch in batches:
            mask: list[bool] = []
            for part in _slices(t.as_py() or "" for t in batch.column(at)):
                mask += [lang != "und" and cost <= most_bits for lang, _, cost in parser.predict(part)]
            yield batch.filter(pa.array(mask, pa.bool_()))
        give_back()

    return docs.mapInArrow(keep, schema)

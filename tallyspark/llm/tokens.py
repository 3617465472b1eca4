"""Token-ID output (operator 9): texts to ids of a public tokenizer, stored as Simple-8b segments and read back.

Rows are range-partitioned by doc_id; a task encodes its rows in order and writes a shard of segments through Spark's
writer, whose commit protocol survives lost executors. A segment is one file body: a header, the
ids and lengths of its documents, the offset of each block's first word, and the words. Readers need only segments and
one total for each shard to know where every document starts.

Defined results: a null text is an empty one, of which the end id is left; null ids come first; rows with the same id
keep together in the order of their texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import simple8b
from tallyspark.llm.memory import give_back
from tallyspark.llm.memory import held as held_model
from tallyspark.session import stage

MAGIC = b"TS8B"
HEAD = struct.Struct("<4sIQQQ")
#: Ids after which a segment is closed; a longer document has a segment of its own.
SEGMENT = 1 << 18
#: Words kept by a worker; beyond it, the third that was used longest ago is dropped.
CACHE = 300_000
#: Symbols of text encoded at once by a worker; a longer text is encoded alone.
SLICE = 4_000_000
#: White space of the tokenizer's word pattern, and two of it together, near which the pattern may break elsewhere.
SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\pZ]"
UNSURE = SPACE + "{2}"
#: A space, or the start of a line's end, that the pattern always breaks before.
BREAK = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n))")
MARKS = ",."
END = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to ids with the tokenizers library, each distinct word once as long as it is kept.

    A byte-level pattern never joins what stands on both sides of a single space between two visible
    characters, nor a visible character with a line's end behind it. A text is cut there, and every piece is encoded on its own, with
    a space before it unless it begins with a line's end. The words and their ids are kept as Arrow and numpy arrays, without a Python object for each.
    """

    def __init__(self, path: str, keep: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        from tokenizers import Tokenizer, pre_tokenizers

        self.keep = keep
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model.dropout = None
        #: The same model for words of letters, which the pattern never splits: only cut at spaces.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: the byte-level alphabet has one letter for each byte.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.marks = [self._alone([c]) for c in MARKS]
        self.words = pa.array([], pa.large_string())
        self.sizes, self.ids, self.used, self.turn = np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int32), 0

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many are of each piece) of pieces encoded one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int32)

    def _together(self, words: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that are safe side by side: encoded in one text, whose ids are told apart by their bytes."""
        texts = ["".join(words.slice(lo, 512).to_pylist()) for lo in range(0, len(words), 512)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.cumsum(np.asarray(pc.binary_length(words), np.int64))
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1, prepend=0).astype(np.int32)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Keeps new words; returns the place of each."""
        ends = pc.starts_with(new, "\n")
        whole = pc.if_else(ends, new, pc.binary_join_element_wise(pa.scalar(" ", new.type), new, pa.scalar("", new.type)))
        letters = pc.match_substring_regex(new, r"^\pL+$")
        odd = pc.match_substring_regex(whole, rf"^(?s:.+){SPACE}|^{SPACE}?$")  # with white space inside, or nothing else
        rest = pc.invert(pc.or_(letters, odd))
        order = np.concatenate([np.flatnonzero(np.asarray(kind)) for kind in (letters, rest, odd)])
        places = np.empty(len(new), np.int32)
        places[order] = np.arange(len(self.words), len(self.words) + len(new), dtype=np.int32)
        parts = [self._together(whole.filter(letters), self.letters), self._together(whole.filter(rest), self.tokenizer), self._alone(whole.filter(odd).to_pylist())]
        self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in parts)])
        self.used = np.concatenate([self.used, np.full(len(new), self.turn, np.int32)])
        return places

    def _forget(self) -> None:
        """Drops the words that were used longest ago, beyond two thirds of those that may be kept."""
        if len(self.words) <= self.keep:
            return
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.keep * 2 // 3])
        begin = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.ids = _gather(self.ids, begin[stay], self.sizes[stay])
        self.words, self.sizes, self.used = self.words.take(pa.array(stay)), self.sizes[stay], self.used[stay]

    def _rows(self, words: pa.Array) -> np.ndarray:
        """The place of each word among those kept; new ones are learned."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            lost = pc.is_null(at)
            missing = words.filter(lost).dictionary_encode()
            rows = np.asarray(pc.fill_null(at, 0), np.int32).copy()
            rows[np.asarray(lost)] = self._learn(missing.dictionary)[np.asarray(missing.indices)]
        else:
            rows = np.asarray(at, np.int32)
        self.used[rows] = self.turn
        return rows

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts, words of each); every word had a space before it, but a text's first and those that begin with a line's end."""
        whole = pa.array(texts, pa.large_string())
        unsure = pc.match_substring_regex(whole, UNSURE)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(unsure, "", whole), "\n", " \n"), " ")
        words, counts = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
        odd = np.flatnonzero(np.asarray(unsure))
        if not len(odd):
            return words, counts
        parts, ends, lo = [], np.cumsum(counts), 0
        for i in odd:
            own = BREAK.split(texts[i])
            parts += [words.slice(lo, ends[i] - 1 - lo), pa.array(own, pa.large_string())]
            lo, counts[i] = ends[i], len(own)
        return pa.concat_arrays([*parts, words.slice(lo)]), counts

    def encode(self, texts: list[str], end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, ids of each text); ``end`` is appended to each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.turn += 1
        words, counts = self._cut(texts)
        firsts = np.cumsum(counts) - counts
        heads = words.take(pa.array(firsts)).dictionary_encode()
        # A comma or full stop behind letters is a word of its own.
        marks = np.zeros(len(words), np.int8)
        for k, c in enumerate(MARKS):
            marks[np.asarray(pc.ends_with(words, c))] = k + 1
        marks[firsts] = 0
        if len(marked := np.flatnonzero(marks)):
            good = np.asarray(pc.match_substring_regex(words.take(pa.array(marked)), rf"^\pL+[{MARKS}]$"))
            marks[marked[~good]] = 0
            words = pc.replace_with_mask(words, pa.array(marks > 0), pc.utf8_slice_codeunits(words.filter(pa.array(marks > 0)), 0, -1))
        rows = self._rows(words)
        del words
        # One table for this slice: the kept words, first words, marks, the end.
        own, each = self._alone(heads.dictionary.to_pylist())
        tail = np.array([] if end is None else [end], np.uint32)
        sizes = np.concatenate([self.sizes, each, *(n for _, n in self.marks), np.full(len(tail), 1, np.int32)])
        table = np.concatenate([self.ids, own, *(ids for ids, _ in self.marks), tail])
        rows = rows.copy()
        rows[firsts] = len(self.sizes) + np.asarray(heads.indices, np.int32)
        first_mark = len(self.sizes) + len(each)
        where = np.flatnonzero(marks)
        entries = first_mark + marks[where].astype(np.int32) - 1
        shift = np.cumsum(marks > 0)[np.cumsum(counts) - 1]
        rows = np.insert(rows, where + 1, entries)
        ends = np.cumsum(counts) + shift
        if end is not None:
            rows = np.insert(rows, ends, first_mark + len(MARKS))
            ends = ends + np.arange(1, len(ends) + 1)
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        each = sizes[rows]
        done = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        out = _gather(table, begin[rows], each)
        self._forget()
        return out, np.diff(done[ends], prepend=0)


def _gather(table: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``table`` that begin at ``begin``, one after the other."""
    done = np.cumsum(sizes, dtype=np.int64)
    total = int(done[-1]) if len(done) else 0
    at = np.repeat((begin - (done - sizes)).astype(np.int32), sizes)
    at += np.arange(total, dtype=np.int32)
    return table[at]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment."""
    words, firsts = simple8b.encode(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, len(firsts), len(doc_ids), len(ids), len(words))
    return b"".join([head, known.tobytes(), numbers.tobytes(), lengths.astype("<i8").tobytes(), firsts.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids) of a segment."""
    magic, blocks, docs, n, count = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEAD.size
    parts = []
    for kind, k in (("u1", docs), ("<i8", docs), ("<i8", docs), ("<u4", blocks), ("<u8", count)):
        part = np.frombuffer(body, kind, k, at)
        parts.append(part)
        at += part.nbytes
    known, numbers, lengths, firsts, words = parts
    return [int(x) if ok else None for x, ok in zip(numbers, known, strict=True)], lengths, simple8b.decode(words, firsts, n)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py() or ""
        if texts and size + len(text) > SLICE:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _write(batches: Iterable[pa.RecordBatch], path: str, segment: int) -> Iterator[pa.RecordBatch]:
    encoder, shard, start = held_model(("tokens", path), lambda: Encoder(path)), TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []
    n = 0

    def close() -> pa.RecordBatch:
        nonlocal docs, sizes, held, n, start
        body = pack(docs, np.concatenate(sizes), np.concatenate(held))
        row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([n], pa.int64()), "body": pa.array([body], pa.binary())})
        start += n
        docs, sizes, held, n = [], [], [], 0
        return row

    for batch in batches:
        for some, texts in _slices(batch):
            ids, lengths = encoder.encode(texts)
            ends = np.cumsum(lengths)
            lo = 0
            while lo < len(some):
                done = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + segment - n, side="right")))
                docs += some[lo:hi]
                sizes.append(lengths[lo:hi])
                held.append(ids[done : int(ends[hi - 1])])
                n += int(ends[hi - 1]) - done
                lo = hi
                if n >= segment or lo < len(some):
                    yield close()
    if docs:
        yield close()
    give_back()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs, lengths, ids = unpack(body.as_py())
            raw = ids.astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            begins = ends - lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    give_back()


def write_shards(docs: DataFrame, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Encodes ``docs`` in ascending doc_id order and returns the written segments (shard, start in the shard, n_ids, body)."""
    path = path or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segments = dealt.mapInArrow(lambda batches: _write(batches, path, segment), "shard int, start long, n_ids long, body binary")
    return stage(docs.sparkSession, segments, "tokens", compression="none")


def read_shards(segments: DataFrame) -> DataFrame:
    """For every document in ``segments``: doc_id, start (ids before it), n_tokens, ids_crc32."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row for each writing task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = segments.select("shard", "start", "body").join(F.broadcast(totals), "shard").select((F.col("start") + F.col("base")).alias("start"), "body")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Writes ``docs`` as token segments and returns what reading them back gives."""
    return read_shards(write_shards(docs, path, segment))

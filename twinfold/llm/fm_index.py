"""Benchmark decontamination by an FM-index per training shard.

A shard is a stretch of documents that one task holds at once. Its text, as symbols of words, is
sorted by suffixes; the column of symbols before them (the Burrows-Wheeler transform) lies in a
wavelet matrix. Test phrases are searched backwards, all at once, by ranks in that matrix; what is
found is located by walking back to a sampled suffix position, and the words inside any occurrence
are merged to spans.

Words of no phrase can be in no occurrence. They end a run of words; runs shorter than the
shortest phrase are left out of the index, as no phrase fits in.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.sources.package import ship_package

WINDOW = 10  # consecutive words of a phrase
SAMPLED = 8  # every so many places of a run the suffix position is kept
SHARD_BYTES = 16_000_000  # text of a shard; a longer document is a shard of its own
BLOCK_BYTES = 32_000_000  # test items searched at once

_WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The places of ``text`` in the order of what begins there. Symbol 0 ends a run and the text;
    nothing is compared beyond it: equal rests of runs go by place.

    The first symbols are packed into one number and sorted; places still equal are sorted by the
    rank of what follows, over twice the length each time."""
    size = len(text)
    stops = np.flatnonzero(text == 0)
    places = np.arange(size)
    rest = stops[np.searchsorted(stops, places)] - places
    bits = max(int(symbols).bit_length(), 1)
    reach = 62 // bits
    key = text.astype(np.int64)
    for k in range(1, reach):
        key <<= bits
        inside = np.flatnonzero(rest > k)
        key[inside] |= text[inside + k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(size, dtype=bool)  # a row that differs from the one above, or ended within reach
    fresh[1:] = (key[1:] != key[:-1]) | (rest[order[1:]] < reach)
    begin = np.maximum.accumulate(np.where(fresh, places, 0))
    rank = np.empty(size, dtype=np.int64)
    rank[order] = begin
    rows = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(rows):
        found = order[rows]
        both = rank[found] * size + rank[found + reach]
        way = np.argsort(both, kind="stable")
        found, both = found[way], both[way]
        order[rows] = found
        fresh = np.append(True, both[1:] != both[:-1])
        rank[found] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        rows = rows[~(fresh & np.append(fresh[1:], True))]
        reach *= 2
    return order


class Bits:
    """A row of bits that counts the ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def ones(self, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class WaveletMatrix:
    """Symbols by their bits, highest first; rows are split by each bit before the next."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - np.count_nonzero(bit))))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, row, zeros in self.levels:
            ones = row.ones(at)
            at = np.where(symbol >> shift & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for _, row, zeros in self.levels:
            bit, ones = row.get(at), row.ones(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at - self.first[symbol]


class FmIndex:
    """Backward search over runs of symbols from 1, each run ended by a 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_array(text, symbols)
        self.size = len(text)
        self.smaller = np.cumsum(np.bincount(text, minlength=symbols + 2)) - np.bincount(text, minlength=symbols + 2)
        self.before = WaveletMatrix(text[order - 1].astype(np.int64), max(int(symbols).bit_length(), 1))
        starts = np.flatnonzero(np.append(True, text[:-1] == 0))
        places = np.arange(self.size)
        within = places - starts[np.searchsorted(starts, places, side="right") - 1]
        sampled = (within % SAMPLED == 0)[order]  # with every start of a run, so no walk leaves its run
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase (a row, last symbol first) the first row of its occurrences and their end."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size)
        open_ = np.arange(len(phrases))
        for k in range(phrases.shape[1]):
            open_ = open_[(lengths[open_] > k) & (low[open_] < high[open_])]
            symbol = phrases[open_, k]
            for end in (low, high):
                end[open_] = self.smaller[symbol] + self.before.rank(symbol, end[open_])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row."""
        found, steps = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            here = rows[open_]
            known = self.sampled.get(here)
            done = open_[known]
            found[done] = self.positions[self.sampled.ones(rows[done])] + steps[done]
            open_ = open_[~known]
            symbol, rank = self.before.symbol_and_rank(rows[open_])
            rows[open_] = self.smaller[symbol] + rank
            steps[open_] += 1
        return found


@dataclass
class Phrases:
    """The windows of test items: distinct rows of symbols, last word first, and their items."""

    words: list[bytes]
    rows: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray  # item numbers, window by window
    first: np.ndarray  # where the owners of each window begin
    items: list[str]

    @staticmethod
    def of(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
        split = [(name, _words((text or "").encode("utf-8", "surrogatepass").lower())) for name, text in items]
        words = sorted({w for _, own in split for w in own})
        symbol = {w: i for i, w in enumerate(words, start=1)}
        names = sorted({name for name, own in split if own and name is not None})
        number = {name: i for i, name in enumerate(names)}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for name, own in split:
            symbols = [symbol[w] for w in own]
            for k in range(max(len(own) - window + 1, 1) if own else 0):
                owners[tuple(symbols[k:k + window][::-1])] |= {number[name]} if name is not None else set()
        rows = np.zeros((len(owners), window), dtype=np.int64)
        for i, row in enumerate(owners):
            rows[i, :len(row)] = row
        return Phrases(
            words, rows, np.array([len(r) for r in owners], dtype=np.int64),
            np.array([i for own in owners.values() for i in sorted(own)], dtype=np.int64),
            np.cumsum([0, *map(len, owners.values())]), names)


def _ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... over ``lengths[i]`` numbers, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """Documents cut into words; ``hit`` marks those inside an occurrence, ``items`` holds the names
    of the items found in each document."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset:texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        lower = _LOWER[self.data]
        inside = _WORD_BYTES[lower]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]  # words end with their document
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[edges] = inside[edges]
        ends[:-1] &= ~inside[1:]
        ends[edges - 1] = inside[edges - 1]
        self.begin, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        cuts = np.append(0, np.cumsum(self.end - self.begin))
        self.words = pa.Array.from_buffers(pa.large_binary(), len(self.begin), [
            None, pa.py_buffer(cuts.astype("<i8")), pa.py_buffer(lower[inside])])
        self.word_of = np.searchsorted(self.begin, self.offsets)  # the first word of each document
        self.hit = np.zeros(len(self.begin), dtype=bool)
        self.items: dict[int, set[str]] = defaultdict(set)

    def search(self, phrases: Phrases) -> None:
        if not len(phrases.rows) or not len(self.begin):
            return
        symbols = pc.fill_null(pc.index_in(self.words, pa.array(phrases.words, pa.large_binary())), -1).to_numpy() + 1
        known = symbols > 0
        starts, ends = known.copy(), known.copy()
        cuts = self.word_of[(self.word_of > 0) & (self.word_of < len(known))]
        starts[1:] &= ~known[:-1]
        starts[cuts] = known[cuts]
        ends[:-1] &= ~known[1:]
        ends[cuts - 1] = known[cuts - 1]
        begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        long_ = end - begin >= phrases.lengths.min()
        begin, lengths = begin[long_], (end - begin)[long_]
        if not len(begin):
            return
        words = _ranges(begin, lengths + 1)  # the last of each is the place of the 0
        text = symbols[np.minimum(words, len(symbols) - 1)].astype(np.int32)
        text[np.cumsum(lengths + 1) - 1] = 0
        index = FmIndex(text, len(phrases.words))
        low, high = index.search(phrases.rows, phrases.lengths)
        counts = high - low
        window = np.repeat(np.arange(len(counts)), counts)
        first = words[index.locate(_ranges(low, counts))]
        change = np.zeros(len(symbols) + 1, dtype=np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + phrases.lengths[window], -1)
        self.hit |= np.cumsum(change[:-1]) > 0
        document = np.searchsorted(self.word_of, first, side="right") - 1
        for pair in np.unique(document * len(counts) + window).tolist():
            doc, found = divmod(pair, len(counts))
            own = phrases.owners[phrases.first[found]:phrases.first[found + 1]]
            self.items[doc].update(phrases.items[i] for i in own.tolist())

    def spans(self, doc: int) -> list[tuple[int, int]]:
        """Stretches of hit words of a document in its bytes; neighbouring hits are one stretch."""
        low, high = self.word_of[doc], self.word_of[doc + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], self.hit[low:high].view("i1"), [0]])))
        base = self.offsets[doc]
        return [(int(self.begin[low + a] - base), int(self.end[low + b - 1] - base))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]

    def text(self, doc: int) -> np.ndarray:
        return self.data[self.offsets[doc]:self.offsets[doc + 1]]


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[Broadcast]:
    """The test items in broadcasts of about ``block_bytes`` each, made one after the other, so the
    driver never holds more than one of them."""
    spark = items.sparkSession
    named = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    total = named.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    count = -(-total // block_bytes)
    block = F.pmod(F.xxhash64("name", "text"), F.lit(max(count, 1)))
    return [
        spark.sparkContext.broadcast([tuple(r) for r in named.where(block == i).distinct().collect()])  # a bounded block
        for i in range(count)
    ]


def _shards(batches: Iterator[pa.RecordBatch], column: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(int(np.searchsorted(sizes, done + shard_bytes, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _searched(blocks: list[Broadcast], window: int, texts: pa.Array, held: dict) -> Shard:
    shard = Shard(texts)
    for i, block in enumerate(blocks):
        if held.get("block") != i:
            held.update(block=i, phrases=Phrases.of(block.value, window))
        shard.search(held["phrases"])
    return shard


def find_contamination(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str,
                       item_text_col: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every document: its words, those inside any occurrence
    of ``window`` consecutive words of a test item, the ids of the items found as sorted texts, and
    the spans to remove in code points, end exclusive, merged.

    A-Z is lower-cased; words are runs of digits, letters a-z and characters beyond ASCII. An item of
    fewer words is one phrase; one without words has none. Null texts have no words. A null item id
    hits words but is not listed; repeated items count once; rows of documents stay as they are,
    whatever their id; without items nothing is hit; other columns are ignored. Documents are
    not shuffled; items go to the tasks in blocks of bounded size, each searched against all rows.
    """
    ship_package(documents.sparkSession)
    blocks = _item_blocks(items, item_id_col, item_text_col, block_bytes)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for part in _shards(batches, 1, shard_bytes):
            shard = _searched(blocks, window, part.column(1), held)
            hits = np.append(0, np.cumsum(shard.hit))
            n_hit = np.diff(hits[shard.word_of])
            spans = []
            for doc, n in enumerate(n_hit.tolist()):
                if not n:
                    spans.append([])
                    continue
                points = np.append(0, np.cumsum(shard.text(doc) & 0xC0 != 0x80))
                spans.append([{"start": int(points[a]), "end": int(points[b])} for a, b in shard.spans(doc)])
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.diff(shard.word_of), pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([sorted(shard.items.get(doc, ())) for doc in range(part.num_rows)], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["id", "n_words", "n_hit", "items", "spans"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>")


def remove_contamination(documents: DataFrame, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str,
                         window: int = WINDOW) -> DataFrame:
    """``documents`` with the spans of ``find_contamination`` cut out of the text; all rows and all
    columns stay, texts without an occurrence are unchanged."""
    ship_package(documents.sparkSession)
    blocks = _item_blocks(items, item_id_col, item_text_col, BLOCK_BYTES)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for part in _shards(batches, at, SHARD_BYTES):
            shard = _searched(blocks, window, part.column(at), held)
            texts = part.column(at).to_pylist()
            for doc in np.flatnonzero(np.diff(np.append(0, np.cumsum(shard.hit))[shard.word_of])).tolist():
                data, cuts = shard.text(doc).tobytes(), [0, *(x for span in shard.spans(doc) for x in span), None]
                texts[doc] = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode("utf-8", "replace")
            columns = part.columns
            columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return documents.mapInArrow(run, documents.schema)

"""Token ids in files of patched frame-of-reference blocks.

A file is a run of segments; a segment holds whole documents:

    header    5 numbers of 32 bits: documents, ids, ids per block, blocks, exceptions
    documents the ids of each document, 32 bits
    blocks    minimum (32 bits), width (8 bits) of each
    index     where the packed bits of each block begin, 32 bits, in bytes
    first     the first exception of each block, 32 bits
    places    of the exceptions in their block, 16 bits; values, 32 bits
    packed    ids less the minimum, in the width of the block; exceptions are packed as 0

The width of a block is that of the value at a percentile of the block; the values beyond it are the
exceptions. All numbers are little-endian. Files live in a Parquet table, a row per segment, as
Spark's own writers commit whole tasks only and reach every store.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import WordTable, runs
from .workers import prepare, released, sliced

BLOCK_IDS = 512
PERCENTILE = 0.95
SEGMENT_IDS = 1_000_000  # a segment ends with the document that reaches it
SLICE_ROWS, SLICE_BYTES = 4000, 6_000_000  # documents encoded at once
FILE_BYTES = 256_000_000  # about so much text makes a file, where its number is not given
MOST_CACHED = 500_000  # words a worker remembers
END_ID = 1


@lru_cache(maxsize=1)
def _width_of() -> np.ndarray:
    return np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def _widths(rest: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    high = rest >> 16
    low = _width_of()[rest & 0xFFFF]
    return np.where(high > 0, _width_of()[high] + np.uint8(16), low) if high.any() else low


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The rows of values, each in ``width`` bits, as rows of bytes."""
    kind = "<u2" if width <= 16 else "<u4"
    digits = np.unpackbits(
        values.astype(kind).view("u1").reshape(*values.shape, -1), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(digits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    kind, bits = ("<u2", 16) if width <= 16 else ("<u4", 32)
    digits = np.zeros((len(rows), count, bits), dtype=np.uint8)
    found = np.unpackbits(rows, axis=1, count=width * count, bitorder="little")
    digits[:, :, :width] = found.reshape(len(rows), count, width)
    return np.packbits(digits, axis=2, bitorder="little").reshape(len(rows), -1).view(kind)


def write_segment(ids: np.ndarray, lengths: np.ndarray, block_ids: int = BLOCK_IDS,
                  percentile: float = PERCENTILE) -> bytes:
    """One segment from the ids (32 bits, unsigned) of documents of the given lengths."""
    blocks = -(-len(ids) // block_ids)
    padded = np.zeros(blocks * block_ids, dtype=np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids):] = ids[-1]
    grid = padded.reshape(blocks, block_ids)
    low = grid.min(axis=1) if blocks else np.zeros(0, dtype=np.uint32)
    rest = grid - low[:, None]
    bits = _widths(rest)
    at = min(block_ids - 1, int(np.ceil(percentile * block_ids)) - 1)
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, dtype=np.uint8)
    odd = bits > width[:, None]
    block_of, place = np.nonzero(odd)
    values = rest[odd]
    rest[odd] = 0
    sizes = (width.astype(np.int64) * block_ids + 7) // 8
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    packed = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            rows = _pack(rest[own], int(w))
            packed[(begin[own][:, None] + np.arange(rows.shape[1])).ravel()] = rows.ravel()
    first = np.searchsorted(block_of, np.arange(blocks))
    parts = [
        np.array([len(lengths), len(ids), block_ids, blocks, len(values)], "<u4"), lengths.astype("<u4"),
        low.astype("<u4"), width.astype("u1"), begin.astype("<u4"), first.astype("<u4"),
        place.astype("<u2"), values.astype("<u4"), packed,
    ]
    return b"".join(p.tobytes() for p in parts)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of the documents) of a segment."""
    def take(n: int, kind: str, at: int) -> tuple[np.ndarray, int]:
        found = np.frombuffer(data, kind, n, at)
        return found, at + found.nbytes

    (n_docs, n_ids, block_ids, blocks, odd), at = take(5, "<u4", 0)
    n_docs, n_ids, block_ids, blocks, odd = map(int, (n_docs, n_ids, block_ids, blocks, odd))
    lengths, at = take(n_docs, "<u4", at)
    low, at = take(blocks, "<u4", at)
    width, at = take(blocks, "u1", at)
    begin, at = take(blocks, "<u4", at)
    first, at = take(blocks, "<u4", at)
    place, at = take(odd, "<u2", at)
    values, at = take(odd, "<u4", at)
    packed = np.frombuffer(data, "u1", offset=at)
    grid = np.zeros((blocks, block_ids), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            size = (int(w) * block_ids + 7) // 8
            rows = packed[begin[own].astype(np.int64)[:, None] + np.arange(size)]
            grid[own] = _unpack(rows, int(w), block_ids)
    counts = np.diff(np.append(first.astype(np.int64), odd))
    grid[np.repeat(np.arange(blocks), counts), place] = values
    return (grid + low[:, None]).ravel()[:n_ids].astype("<u4"), lengths


_pieces = re.compile(r"[ \n\t\r]+").split
_PLAIN = "\u0130"  # letters below it fold their case and compose one by one, without marks
_PLAIN_ENDS = pa.array([c for c in map(chr, range(ord(_PLAIN))) if c.isalnum()])


class WordIds:
    """Ids of what stands between white space, by the tokenizers library.

    Its words never run over white space, and folding case and composing letters act within them,
    so a text may be cut there; marks after a plain letter or digit are words of their own. The
    pieces of many texts are made distinct, those known are found in a table of words, and only new ones go
    to the library: pieces of plain letters all together, parted again where an id ends a word,
    others one by one. ASCII letters need no composing and are bytes already, so they go to a copy of the
    tokenizer that only merges.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.encode = Tokenizer.from_str(tokenizer_json).encode_batch_fast
        merging = Tokenizer.from_str(tokenizer_json)
        merging.normalizer, merging.pre_tokenizer = None, WhitespaceSplit()
        self.merge = merging.encode_batch_fast
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        self.special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        suffix = model["end_of_word_suffix"]
        self.ends = np.zeros(1 << 20, dtype=bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.known = WordTable(MOST_CACHED)

    @staticmethod
    def _ids(encode: Callable, text: str) -> list[int]:
        return encode([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, ids, sizes): the ids of new words, one word after the other in the order given."""
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        plain = [i for i in letters if words[i].isascii()]
        other = [i for i in letters if not words[i].isascii() and max(words[i]) < _PLAIN]
        order, ids, sizes = [], [], []
        for group, lower, encode in ((plain, True, self.merge), (other, False, self.encode)):
            text = " ".join(map(words.__getitem__, group))
            found = np.array(self._ids(encode, text.lower() if lower else text) if group else [], dtype="<u4")
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(group):  # else the words are asked for one by one
                order += group
                ids.append(found)
                sizes.append(np.diff(cuts, prepend=0))
        done = set(order)
        rest = [i for i in range(len(words)) if i not in done]
        each = [np.array(self._ids(self.encode, words[i]), dtype="<u4") for i in rest]
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return order + rest, np.concatenate([*ids, *each, np.zeros(0, "<u4")]), np.concatenate(sizes)

    def encode_texts(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(texts)
        if odd.any():  # these separators are no white space to the tokenizer
            lists = [list(filter(None, _pieces(texts[i].as_py()))) if o else split[i].as_py() for i, o in enumerate(odd.tolist())]
            split = pa.array(lists, pa.list_(pa.string()))
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.flatten())
        whole = coded.dictionary
        bare = pc.utf8_rtrim(whole, characters=punctuation)
        parted = pc.and_(pc.less(pc.utf8_length(bare), pc.utf8_length(whole)),
                         pc.is_in(pc.utf8_slice_codeunits(bare, -1), _PLAIN_ENDS))
        if self.special:
            parted = pc.and_not(parted, pc.match_substring_regex(whole, self.special))
        parted = parted.to_numpy(zero_copy_only=False)
        marks = pc.replace_with_mask(whole, pa.array(parted), _after(whole, bare).filter(pa.array(parted)))
        # a parted word is its bare part and its marks, another is an empty part and itself
        first = pc.if_else(pa.array(parted), bare, "")
        pieces = pc.dictionary_encode(pa.concat_arrays([first, marks]))
        ids, begin, size = self.known.look_up(pieces.dictionary, self._learn)
        which = pieces.indices.to_numpy()
        which = np.stack([which[:len(whole)], which[len(whole):]], axis=1)[coded.indices.to_numpy()].ravel()
        ends = np.append(0, np.cumsum(size[which]))
        data = ids[runs(begin[which], size[which])].tobytes()
        cuts = (4 * ends[2 * (offsets - offsets[0])]).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _after(whole: pa.Array, front: pa.Array) -> pa.Array:
    """What follows ``front`` in each text that begins with it."""
    data = np.frombuffer(whole.buffers()[2] or b"", "u1")
    offsets = np.frombuffer(whole.buffers()[1], "<i4")[whole.offset:whole.offset + len(whole) + 1].astype(np.int64)
    sizes = pc.binary_length(front).to_numpy(zero_copy_only=False).astype(np.int64)
    rest = np.diff(offsets) - sizes
    cuts = np.append(0, np.cumsum(rest)).astype("<i4")
    return pa.Array.from_buffers(pa.string(), len(whole), [
        None, pa.py_buffer(cuts), pa.py_buffer(data[runs(offsets[:-1] + sizes, rest)])])


@lru_cache(maxsize=2)
def _loaded(tokenizer_json: str) -> WordIds:
    return WordIds(tokenizer_json)


def _encoded(batch: pa.RecordBatch, words: WordIds) -> Iterator[tuple[object, bytes]]:
    for part in sliced(batch, 1, SLICE_ROWS, SLICE_BYTES):
        yield from zip(part.column(0).to_pylist(), words.encode_texts(part.column(1)), strict=True)


def write_files(documents: DataFrame, id_col: str, text_col: str, tokenizer_json: str, path: str,
                end_id: int = END_ID, files: int | None = None) -> None:
    """Encode every whole text, end each document with ``end_id``, and write the ids in ascending
    order of the document's id into ``files`` files (default: one per ``FILE_BYTES`` of text, at least as
    many as shuffle partitions).

    Null texts count as empty and hold the end id alone; a null id comes first; rows of equal ids
    stand side by side, ordered by a hash of the text, and may fill several files; other columns are
    ignored. The table at ``path`` has columns
    file, segment, offset (ids of the file before the segment), n_ids, doc_ids, data.
    """
    spark = documents.sparkSession
    prepare(spark)
    content = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary: of fixed size
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded(content.value)
        file, number, offset = TaskContext.get().partitionId(), 0, 0
        doc_ids, pieces, held = [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(p) // 4 for p in pieces], dtype=np.int64)
            data = write_segment(np.frombuffer(b"".join(pieces), "<u4"), lengths)
            return pa.RecordBatch.from_pydict({
                "file": pa.array([file], pa.int32()), "segment": pa.array([number], pa.int32()),
                "offset": pa.array([offset], pa.int64()), "n_ids": pa.array([held], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(id_type)), "data": pa.array([data], pa.binary()),
            })

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, ids in _encoded(batch, words):
                ids += end
                doc_ids.append(doc_id)
                pieces.append(ids)
                held += len(ids) // 4
                if held >= SEGMENT_IDS:
                    yield row()
                    number, offset = number + 1, offset + held
                    doc_ids, pieces, held = [], [], 0
        if doc_ids:
            yield row()

    kind = documents.schema[id_col].dataType.simpleString()
    named = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = files
    if parts is None:
        size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = ["id", F.xxhash64("text"), F.monotonically_increasing_id()]  # the last parts equal rows
    ordered = named.repartitionByRange(parts, *order).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(
        released(segments), f"file int, segment int, offset bigint, n_ids bigint, doc_ids array<{kind}>, data binary",
    ).write.option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files at ``path``: ``start`` counts
    the ids of all documents before it, ``ids`` are little-endian 32-bit integers."""
    prepare(spark)
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("file").agg(F.sum("n_ids").alias("n")).select(  # a row per file
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = read_segment(batch.column(2)[i].as_buffer())
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                data = ids.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(1)[i].values, pa.array(begins + batch.column(0)[i].as_py()),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([data[4 * b:4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    placed = table.join(F.broadcast(starts), "file").select(
        (F.col("file_start") + F.col("offset")).alias("start"), "doc_ids", "data")
    return placed.mapInArrow(released(documents), f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")



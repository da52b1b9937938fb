"""N-gram Jaccard join by parity sketches.

The distinct shingles of a document are dealt to m parts by their hash; a part is a sketch of 2^32
bits, and a shingle flips the bit its hash names. Two sketches differ in a part only if some shingle in
one document alone fell there, so the number of differing parts, like the Hamming distance,
is at most the symmetric difference. At Jaccard similarity s a document of n shingles and a
larger one differ in at most d = n * (1 - s) / s shingles; with m > d parts, m - d are equal. So
documents are joined on equal parts, per band of sizes, and the pairs found are verified exactly.
A part is stored as the XOR of one random number per set bit, which tells sketches apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.components import connected_components
from twinfold.operators.scratch import forget, materialize
from twinfold.operators.skew import skew_join

from .groups import gridded, whole_groups
from .workers import prepare, released, sliced

ALL_PAIRS = 4  # members of a bucket up to which all its pairs are formed at once
CELL_ROWS = 2000
MOST_SAMPLED, COMMON_IN = 4000, 4  # documents from which common shingles are learnt, and how many share one
SLICE_ROWS, SLICE_BYTES = 256, 1_000_000  # documents whose sets a worker holds at once
MOST_CACHED = 200_000
MOST_BROADCAST = 200_000  # copies (an id and a digest) that may be broadcast; beyond, a shuffled join
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_CACHED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = _WordHashes()


def _forget_words() -> None:
    _hashes.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words. Words stand between ASCII
    white space, with A-Z in lower case; a shorter sequence of words is one shingle of its own."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = _mixed(total * _MIX[2] + each[i:i + n] + np.uint64(i + 1))
    return np.unique(total)


def _band(n: int, similarity: float) -> int:
    """Band j holds the sizes in (1/s)^j up to (1/s)^(j+1); a pair is in one band or in neighbours."""
    return int(math.log(n) / -math.log(similarity) + 1e-9)


def _parts_of_band(band: int, similarity: float) -> tuple[int, int]:
    """(differing shingles possible, spare parts) of pairs whose smaller document is in the band."""
    largest = math.ceil((1 / similarity) ** (band + 1)) + 1
    differing = int(largest * (1 - similarity) / similarity + 1e-9)
    return differing, 2 + math.ceil(differing * 0.08)


def sketch_keys(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """Join keys of a document: one per telling part, in its band and in the band below.

    Parts with no bit set or with ``common`` shingles only (a sorted array; any will do) are
    weak: many documents may share them. With e spare parts, at least e parts of a pair have no
    shingle of one document alone, so a document with fewer than e weak parts can leave them out:
    of those parts, which are weak in both or in neither, one is left. Only between two documents
    that both have e weak parts or more do weak parts count, and both then keep theirs.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.int64)
    keys: list[np.ndarray] = []
    band = _band(n, similarity)
    place = np.searchsorted(common, shingles)
    rare = common[np.minimum(place, len(common) - 1)] != shingles if len(common) else np.ones(n, dtype=bool)
    for joined in (band, band - 1):
        if joined < 0:
            continue
        differing, spare = _parts_of_band(joined, similarity)
        if not differing:
            continue  # only equal sets, which are one class already
        parts = differing + spare
        part = ((shingles >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        bit = _mixed((shingles & np.uint64(0xFFFFFFFF)) + np.uint64(1))
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        begin = np.cumsum(counts) - counts
        filled = np.flatnonzero(counts)
        value = np.zeros(parts, dtype=np.uint64)
        value[filled] = np.bitwise_xor.reduceat(bit[order], begin[filled])
        strong = (value != 0) & (np.bincount(part[rare], minlength=parts) > 0)
        used = np.flatnonzero(strong) if parts - strong.sum() < spare else np.arange(parts)
        seed = np.uint64((joined * 1_000_003 + 1) * int(_MIX[3]) % (1 << 64))
        keys.append(_mixed(value[used] ^ _mixed(used.astype(np.uint64) + seed)))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from sliced(batch, column, SLICE_ROWS, SLICE_BYTES)


def _common(documents: DataFrame, width: int) -> np.ndarray:
    """Shingles that stand in ``COMMON_IN`` or more of about ``MOST_SAMPLED`` documents drawn by
    hash: passages that many share. They only steer which parts are joined, not what is found."""
    chance = min(1.0, MOST_SAMPLED / max(documents.count(), 1))
    drawn = documents.where(F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(1 << 30)) < int(chance * (1 << 30)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 0):
            found = np.concatenate([shingle_set(t.as_py(), width) for t in part.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    counted = drawn.select("text").mapInArrow(released(sets, _forget_words), "shingle bigint").groupBy("shingle").count()
    rows = counted.where(F.col("count") >= COMMON_IN).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def _sets(documents: DataFrame, width: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(id, n, class hashes, keys) of each document; nothing of the text is kept."""
    shared = documents.sparkSession.sparkContext.broadcast(common)  # of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 1):
            counts, digests, keys = [], [], []
            for text in part.column(1):
                found = shingle_set(text.as_py(), width)
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(sketch_keys(found, similarity, shared.value))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))),
            ], ["id", "n", "digest", "keys"])

    return documents.mapInArrow(released(run, _forget_words), "id bigint, n bigint, digest binary, keys array<bigint>")


def _bucket_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, key) from sorted (key, id): all pairs of a small bucket; of a crowded one the links to
    its first member, with b = a for the first, and the key, by which it is looked at again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd_key, crowd_first = None, None  # of a bucket that runs over several batches
        held: list[tuple[int, int]] = []
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if held:
                keys = np.concatenate([np.array([k for k, _ in held]), keys])
                ids = np.concatenate([np.array([i for _, i in held]), ids])
                held = []
            if not len(keys):
                continue
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            end = np.append(start[1:], len(keys))
            size = end - start
            out_a, out_b, out_k = [], [], []
            if crowd_key is not None and keys[0] == crowd_key:  # the first member has been told already
                members = ids[:end[0]]
                out_a.append(np.full(len(members), crowd_first))
                out_b.append(members)
                out_k.append(np.full(len(members), crowd_key))
                start, end, size = start[1:], end[1:], size[1:]
            else:
                crowd_key = None
            if len(start) and size[-1] <= ALL_PAIRS:  # may go on in the next batch
                held = list(zip(keys[start[-1]:].tolist(), ids[start[-1]:].tolist(), strict=True))
                start, end, size = start[:-1], end[:-1], size[:-1]
                crowd_key = None
            small = np.flatnonzero((size > 1) & (size <= ALL_PAIRS))
            for i in range(ALL_PAIRS):
                for j in range(i + 1, ALL_PAIRS):
                    own = start[small[size[small] > j]]
                    out_a.append(ids[own + i])
                    out_b.append(ids[own + j])
                    out_k.append(np.zeros(len(own), dtype=np.int64))
            large = np.flatnonzero(size > ALL_PAIRS)
            for g in large:
                out_a.append(np.full(size[g], ids[start[g]]))
                out_b.append(ids[start[g]:end[g]])
                out_k.append(np.full(size[g], keys[start[g]]))
            if len(large) and end[large[-1]] == len(keys):
                crowd_key, crowd_first = keys[-1], ids[start[large[-1]]]
            yield _pairs(out_a, out_b, out_k)
        if len(held) > 1:
            ids_left = [i for _, i in held]
            found = [(a, b) for i, a in enumerate(ids_left) for b in ids_left[i + 1:]]
            yield _pairs([np.array([a for a, _ in found])], [np.array([b for _, b in found])], [np.zeros(len(found))])

    return rows.mapInArrow(released(run), "a bigint, b bigint, key bigint")


def _pairs(a: list, b: list, key: list) -> pa.RecordBatch:
    columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (a, b, key)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "key"])


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity sketch of 8 to 16 bits per shingle: a power of two, so that the longer of two folds
    to the length of the other."""
    size = 1 << max(6, (8 * len(shingles) - 1).bit_length())
    flips = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hamming distances of the last axis."""
    return np.bitwise_count(one ^ two).sum(axis=-1, dtype=np.int64)


def _crossing(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b) of the pairs of a cell that are in different components so far and whose sketches
    differ in no more bits than similar documents may. With ``forest`` a pair joins two components
    for the rest of the cell, so a cell tells fewer pairs than it has rows. ``rows`` are (key, cell_a,
    cell_b, stripe, id, component, n, bits), sorted by the first three."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["key", "cell_a", "cell_b"]):
            ids, n = (table[c].to_numpy() for c in ("id", "n"))
            part = table["component"].to_numpy().copy()
            stripe, low, high = (table[c].to_numpy() for c in ("stripe", "cell_a", "cell_b"))
            sketch = table["bits"]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s < 2 or (part[s:e] == part[s]).all():
                    continue
                bits = [np.frombuffer(sketch[i].as_buffer(), np.uint8) for i in range(s, e)]
                size = min(map(len, bits))
                grid = np.stack([_folded(x, size) for x in bits])
                for i in range(s, e - 1):
                    others = np.arange(i + 1, e)
                    apart = part[others] != part[i]
                    if low[i] != high[i]:
                        apart &= stripe[others] != stripe[i]
                    others = others[apart]
                    if len(others):
                        most = (n[others] + n[i]) * (100 - percent) // (100 + percent)
                        near = others[_differing(grid[others - s], grid[i - s]) <= most]
                        if forest and len(near):
                            joined, first = np.unique(part[near], return_index=True)
                            near = near[first]
                            own = part[s:e]
                            own[np.isin(own, joined)] = part[i]
                        if len(near):
                            b = ids[near]
                            yield _pairs([np.full(len(b), ids[i])], [b], [np.zeros(len(b))])

    return rows.mapInArrow(released(run), "a bigint, b bigint, key bigint").select("a", "b")


def _distinct(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "pairs")


def _known(pairs: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """(id, n, bits, shingles) of the documents that are in a pair; only these are read again."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 1):
            found = [shingle_set(t.as_py(), width) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(x) for x in found], pa.int64()),
                pa.array([bit_sketch(x) for x in found], pa.binary()),
                pa.array([x.tobytes() for x in found], pa.binary())], ["id", "n", "bits", "shingles"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = materialize(wanted, "wanted")
    known = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    texts = documents.join(known, "id", "left_semi")
    found = materialize(texts.mapInArrow(released(sets, _forget_words), "id bigint, n bigint, bits binary, shingles binary"), "sets")
    forget(wanted)
    return found


def _verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) whose shingle sets reach the similarity. Sketches are compared first; only
    pairs whose sketches differ little take the set of one side to the other."""
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            for x, y, n in zip(batch.column(4), batch.column(5), total, strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(one), len(two))
                good.append(_differing(_folded(one, size), _folded(two, size)) <= n * (100 - percent) // (100 + percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def with_both(rows: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            named = [F.col(c).alias(f"{c}_{end}") for c in columns]
            rows = rows.join(known.select(F.col("id").alias(end), *named), end)
        return rows.select("a", "b", *(f"{c}_{end}" for c in columns for end in ("a", "b")))

    close = materialize(with_both(pairs, "n", "bits").mapInArrow(released(likely), "a bigint, b bigint").distinct(), "likely")
    links = materialize(with_both(close, "shingles").mapInArrow(released(compare), "a bigint, b bigint"), "links")
    forget(close)
    return links


def similar_documents(documents: DataFrame, id_col: str, text_col: str, width: int = 5,
                      similarity: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id): documents link where the Jaccard similarity of their
    distinct shingles reaches ``similarity`` (in whole hundredths); a component is named by the
    smallest id reachable. Exact but for collisions of 64-bit hashes.

    Documents of equal sets are one class from the start, however many; buckets of equal parts are
    linked to their first member and then searched for pairs that are not connected yet, so no
    group is expanded into all its pairs, and no component is missed. Null, empty and wordless texts have 0
    shingles and link with nothing; rows with a null id are returned with a null component; rows of
    an equal id count once if their texts are equal too (of different texts each is a document under
    the same id). Other columns are ignored. Ids are integers.
    """
    spark = documents.sparkSession
    prepare(spark)
    named = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(_sets(named, width, similarity, _common(named, width)), "sketches")
    # the keys take most of the disk and go as soon as they are dealt to buckets
    sets = materialize(sketches.select("id", "n", "digest"), "digests")
    filled = sketches.where("digest is not null and id is not null")
    classes = materialize(filled.groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("rows")), "classes")
    # only the first of a class goes on; copies are told apart without moving the keys of all documents
    repeated = classes.where("rows > 1")
    copies = materialize(skew_join(filled.select("id", "digest"), repeated, "digest", "rows").where(
        "id != first").select("id", "digest"), "copies")
    known = F.broadcast(copies) if copies.count() <= MOST_BROADCAST else copies
    keys = filled.join(known, ["id", "digest"], "left_anti").select(F.explode("keys").alias("key"), "id")
    buckets = keys.repartition("key").sortWithinPartitions("key", "id")
    found = materialize(_bucket_pairs(buckets), "buckets")
    forget(sketches)
    forget(copies)
    texts = named.where("id is not null")
    percent = round(similarity * 100)
    pairs = _distinct(found.select("a", "b"))
    known = _known(pairs, texts, width)
    links = _verified(pairs, known, percent)
    forget(pairs)
    crowded = found.where("key != 0").select("key", F.col("b").alias("id"))
    if links.isEmpty():
        components = None
    else:
        components = materialize(connected_components(links, "a", "b"), "components")
    # first pairs that would connect a bucket if all their sketches told true, then all that are left
    for forest in (True, False):
        rest = _unconnected(crowded, components, known)
        if rest is None:
            break
        cells = gridded(rest, "key", "id", CELL_ROWS)
        cells = cells.repartition("key", "cell_a", "cell_b").sortWithinPartitions("key", "cell_a", "cell_b", "id")
        pairs = _distinct(_crossing(cells, percent, forest))
        forget(rest)
        more = _verified(pairs, known, percent)
        forget(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            components = materialize(connected_components(links, "a", "b"), "components")
    forget(known)
    forget(found)
    named_classes = classes.select("digest", "first", "rows")
    if components is not None:
        named_classes = named_classes.join(components.withColumnRenamed("id", "first"), "first", "left")
    else:
        named_classes = named_classes.withColumn("component", F.lit(None).cast("bigint"))
    named_classes = materialize(named_classes.select(
        "digest", F.coalesce("component", "first").alias("component_id"), "rows"), "class-names")
    light = sets.select("id", "n", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    return skew_join(light, named_classes, "digest", "rows", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _unconnected(crowded: DataFrame, components: DataFrame | None, known: DataFrame) -> DataFrame | None:
    """The members of crowded buckets that are not all in one component, written."""
    if components is None:
        labelled = crowded.withColumn("component", F.col("id"))
    else:
        labelled = crowded.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = materialize(labelled, "crowded")
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    split = materialize(split.select("key"), "split")
    rows = None
    if not split.isEmpty():
        rows = materialize(labelled.join(split, "key", "left_semi").join(known.select("id", "n", "bits"), "id"), "unconnected")
    forget(labelled)
    forget(split)
    return rows

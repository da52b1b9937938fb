"""String similarities: built-in expressions where Spark has them, Arrow batches else."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINKLER_FLOOR, WINKLER_PREFIX, WINKLER_WEIGHT = 0.7, 4, 0.1
# Texts up to this long are compared a whole batch at a time, longer ones one by one.
_BATCH_LETTERS, _BATCH_ROWS = 64, 4096
_LETTER_CLASSES = 80  # apart for digits, letters and signs of ASCII texts in lower case
_SLICE_BYTES = 1 << 20  # of texts that are held as words at once
_SLICE_PAIRS = 1 << 14  # of which a step over all fits the caches
_BATCH_WORDS = 8  # texts of more words are compared as sets one by one


def jaro(a: str, b: str) -> float:
    """Jaro 1989, linear in the text lengths: one queue of positions per letter."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    waiting: dict[str, list[int]] = {}
    for place in range(len(b) - 1, -1, -1):
        waiting.setdefault(b[place], []).append(place)
    letters, places = [], []
    for i, letter in enumerate(a):
        queue = waiting.get(letter)
        while queue and queue[-1] < i - reach:
            queue.pop()
        if queue and queue[-1] <= i + reach:
            letters.append(letter)
            places.append(queue.pop())
    common = len(letters)
    if not common:
        return 0.0
    places.sort()
    swapped = sum(x != b[p] for x, p in zip(letters, places)) // 2
    return (common / len(a) + common / len(b) + (common - swapped) / common) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Winkler 1990: a bonus for a shared prefix, given above a base similarity."""
    base = jaro(a, b)
    if base <= WINKLER_FLOOR:
        return base
    prefix = 0
    for x, y in zip(a[:WINKLER_PREFIX], b[:WINKLER_PREFIX]):
        if x != y:
            break
        prefix += 1
    return base + prefix * WINKLER_WEIGHT * (1 - base)


def _letters(texts: list[str]) -> np.ndarray:
    """Column i holds the code points of text i, zero behind its end."""
    fixed = np.array(texts, dtype=np.str_)
    points = fixed.view(np.uint32).reshape(len(texts), -1).T
    return np.ascontiguousarray(points if points.max() > 255 else points.astype(np.uint8))


def _padded(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Row i holds the code points of text i plus 1, zero behind its end."""
    points = np.array(texts, dtype=np.str_).view(np.uint32).reshape(len(texts), -1)
    points = np.where(np.arange(points.shape[1]) < sizes[:, None], points + 1, 0)
    return points.astype(np.uint8 if points.max() < 255 else np.uint32)


@cache
def _windows(word: type) -> np.ndarray:
    """The bits within so many places (a column) of a place (a row)."""
    places = range(8 * np.dtype(word).itemsize)
    return np.array([[(2 << min(i + reach, places[-1])) - (1 << max(i - reach, 0)) for reach in places] for i in places], dtype=word)


def _as_flags(bits: np.ndarray, width: int) -> np.ndarray:
    """Row i holds the lowest bits of word i."""
    spread = np.unpackbits(bits.view(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
    return spread[:, :width].view(bool)


def _winkler_pairs(codes: np.ndarray, there: np.ndarray, letters: int, sizes: np.ndarray, left: np.ndarray, right: np.ndarray,
                   prefix_bonus: bool) -> np.ndarray:
    """``jaro_winkler`` (or ``jaro``) of pairs of texts as ``_letter_codes``: a step finds the like of one letter of all left
    texts, the first free one within reach in the right, as bits of a word per pair."""
    word = there.dtype.type
    size_l, size_r = sizes[left], sizes[right]
    reach = np.maximum(np.maximum(size_l, size_r) // 2 - 1, 0)
    near = _windows(word)
    free, marked = np.full(len(left), ~word(0)), np.zeros(len(left), dtype=word)
    other = right * letters
    for i in range(int(size_l.max())):
        hits = there.take(other + codes[i].take(left))
        hits &= free
        hits &= near[i].take(reach)
        marked |= (hits != 0).astype(word) << word(i)
        hits &= np.negative(hits)
        free ^= hits
    common = np.bitwise_count(marked).astype(np.int64)
    small = np.ascontiguousarray(codes.T.astype(np.uint8 if letters < 256 else np.uint32))
    a, b = small[left], small[right]
    # a pair has as many marked letters on either side, so in the order of pairs they stand side by side
    differs = np.cumsum(a[_as_flags(marked, a.shape[1])] != b[_as_flags(~free, b.shape[1])])
    ends = np.cumsum(common)
    differs = np.concatenate([[0], differs])
    swapped = (differs[ends] - differs[ends - common]) // 2
    score = (common / size_l + common / size_r + (common - swapped) / np.maximum(common, 1)) / 3
    score[common == 0] = 0.0
    if not prefix_bonus:
        return score
    same = (a[:, :WINKLER_PREFIX] == b[:, :WINKLER_PREFIX]) & (a[:, :WINKLER_PREFIX] != 0)
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    raised = score + prefix * WINKLER_WEIGHT * (1 - score)
    return np.where(score > WINKLER_FLOOR, raised, score)


def winkler_of(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray,
               prefix_bonus: bool = True) -> np.ndarray:
    """``jaro_winkler`` (or ``jaro``) of the pairs ``left[at_left[i]], right[at_right[i]]``: texts, of which a batch of
    pairs has few, are taken apart once; pairs of like sizes are compared together."""
    one = jaro_winkler if prefix_bonus else jaro
    texts, at_left, at_right = _one_list(left, right, at_left, at_right)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    size_l, size_r = sizes[at_left], sizes[at_right]
    score = np.empty(len(at_left))
    fits = (np.minimum(size_l, size_r) > 0) & (np.maximum(size_l, size_r) <= _BATCH_LETTERS)
    for i in np.flatnonzero(~fits).tolist():
        score[i] = one(texts[at_left[i]], texts[at_right[i]])
    order = np.flatnonzero(fits)
    if not len(order):
        return score
    order = order[np.argsort(size_l[order].astype(np.uint8), kind="stable")]
    codes, there, letters = _letter_codes([t[:_BATCH_LETTERS] for t in texts], np.minimum(sizes, _BATCH_LETTERS))
    for start in range(0, len(order), _SLICE_PAIRS):
        some = order[start:start + _SLICE_PAIRS]
        score[some] = _winkler_pairs(codes, there, letters, sizes, at_left[some], at_right[some], prefix_bonus)
    return score


def jaro_of(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
    """``jaro`` of the pairs ``left[at_left[i]], right[at_right[i]]``."""
    return winkler_of(left, right, at_left, at_right, prefix_bonus=False)


def reaches(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray, least: float) -> np.ndarray:
    """False only for pairs whose ``jaro_winkler`` is below ``least``, from the letters they share in any place, taking
    letters of a class for the same. Of empty and long texts nothing is told."""
    counts, sizes, heads = [], [], []
    for texts, end in ((left, -1), (right, -2)):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = _padded([t[:_BATCH_LETTERS] for t in texts], np.minimum(size, _BATCH_LETTERS))
        classes = np.arange(len(texts))[:, None] * _LETTER_CLASSES + points % _LETTER_CLASSES
        cells = np.bincount(classes[points != 0], minlength=len(texts) * _LETTER_CLASSES)
        head = np.full((len(texts), WINKLER_PREFIX), end, dtype=np.int64)
        first = points[:, :WINKLER_PREFIX]
        np.copyto(head[:, :first.shape[1]], first, where=first != 0)
        counts.append(cells.reshape(len(texts), _LETTER_CLASSES).astype(np.uint8))
        sizes.append(size)
        heads.append(head)
    told = np.empty(len(at_left), dtype=bool)
    for start in range(0, len(at_left), _SLICE_PAIRS):
        some_l, some_r = at_left[start:start + _SLICE_PAIRS], at_right[start:start + _SLICE_PAIRS]
        size_l, size_r = sizes[0][some_l], sizes[1][some_r]
        shared = np.minimum(counts[0][some_l], counts[1][some_r]).sum(axis=1, dtype=np.uint16)
        most = (shared / np.maximum(size_l, 1) + shared / np.maximum(size_r, 1) + 1) / 3
        prefix = np.logical_and.accumulate(heads[0][some_l] == heads[1][some_r], axis=1).sum(axis=1)
        most = np.maximum(most, most + prefix * WINKLER_WEIGHT * (1 - most))
        fits = (np.minimum(size_l, size_r) > 0) & (np.maximum(size_l, size_r) <= _BATCH_LETTERS)
        told[start:start + _SLICE_PAIRS] = ~fits | (most >= least - 1e-9)
    return told


def winkler_batch(left: list[str], right: list[str], prefix_bonus: bool = True) -> np.ndarray:
    """``jaro_winkler`` (or ``jaro``) of many pairs."""
    at = np.arange(len(left))
    return winkler_of(left, right, at, at, prefix_bonus)


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau distance (adjacent swaps may be edited further)."""
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    grid = {(-1, -1): far}
    for i in range(len(a) + 1):
        grid[i, -1], grid[i, 0] = far, i
    for j in range(len(b) + 1):
        grid[-1, j], grid[0, j] = far, j
    for i, x in enumerate(a, 1):
        last_col = 0
        for j, y in enumerate(b, 1):
            row, col = last_row.get(y, 0), last_col
            if x == y:
                last_col = j
            grid[i, j] = min(
                grid[i - 1, j - 1] + (x != y), grid[i, j - 1] + 1, grid[i - 1, j] + 1,
                grid[row - 1, col - 1] + (i - row - 1) + 1 + (j - col - 1),
            )
        last_row[x] = i
    return grid[len(a), len(b)]


def damerau_batch(left: list[str], right: list[str]) -> np.ndarray:
    """``damerau`` of many non-empty pairs: each cell of the table is one step for all of them. Two rows are kept and,
    of earlier ones, what a swap can still look back to (Zhao and Sahni, 2020)."""
    a, b = _letters(left), _letters(right)
    rows, columns, count = len(a), len(b), len(left)
    size_a = np.fromiter(map(len, left), np.int64, count)
    size_b = np.fromiter(map(len, right), np.int64, count)
    far = max(rows, columns) + 1
    # one column more than usual: a swap looks back beyond the start
    before, row = np.full((2, columns + 2, count), far, dtype=np.int16)
    row[1:] = np.arange(columns + 1)[:, None]
    swap_row = np.full((columns + 1, count), far, dtype=np.int16)
    last_row = np.full((columns, count), -1, dtype=np.int16)  # where the letter of each column was met in the left text
    edits = np.empty(count, dtype=np.int64)
    for i in range(1, rows + 1):
        before, row = row, before  # ``row`` still holds the row before ``before``, until it is written over
        equal = a[i - 1] == b
        differs = ~equal
        since = i - last_row
        last_column = np.full(count, -1, dtype=np.int16)
        swap_column = np.full(count, far, dtype=np.int16)
        above = row[1].copy()
        row[1] = i
        for j in range(1, columns + 1):
            best = np.minimum(row[j], before[j + 1])
            best += 1
            np.minimum(best, before[j] + differs[j - 1], out=best)
            np.putmask(last_column, equal[j - 1], j)
            np.putmask(swap_row[j], equal[j - 1], before[j - 1])
            np.putmask(swap_column, equal[j - 1], above)
            np.minimum(best, swap_row[j] + since[j - 1], out=best, where=last_column == j - 1)
            np.minimum(best, swap_column + (j - last_column), out=best, where=(since[j - 1] == 1) & differs[j - 1])
            above = row[j + 1].copy()
            row[j + 1] = best
        last_row[equal] = i
        done = np.flatnonzero(size_a == i)
        edits[done] = row[size_b[done] + 1, done]
    return edits


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one machine-word row at a time (Myers, 1999; Hyyro, 2003)."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for letter in b:
        there = masks.get(letter, 0)
        level = ((there & up) + up ^ up) | there | down
        right = (down | ~(level | up)) << 1 | 1
        up, down = ((level & up) << 1 | ~(level | right)) & full, right & level & full
    return len(b) + up.bit_count() - down.bit_count()


def _letter_codes(texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row j holds the code of letter j of every text, 0 behind its end; where each letter of a code stands in a text, as
    the bits of a word; and the number of codes."""
    points = _padded(texts, sizes)
    met = np.bincount(points.ravel())
    met[0] = 0
    letters = np.flatnonzero(met)
    met[letters] = np.arange(1, len(letters) + 1)
    codes = met.take(points)
    width = points.shape[1]
    word = np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64
    there = np.zeros((len(texts), len(letters) + 1), dtype=word)
    codes = np.ascontiguousarray(codes.T)
    there = there.ravel()
    rows = np.arange(len(texts)) * (len(letters) + 1)
    for place in range(width):
        there[rows + codes[place]] |= word(1 << place)
    there[rows] = 0
    return codes, there, len(letters) + 1


def _one_list(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) \
        -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts of both sides, and of those only what any pair names, where pairs are few."""
    if left is not right:
        left, at_right = [*left, *right], at_right + len(left)
    if 2 * len(at_left) < len(left):
        named, place = np.unique(np.concatenate([at_left, at_right]), return_inverse=True)
        left, at_left, at_right = [left[i] for i in named.tolist()], place[:len(at_left)], place[len(at_left):]
    return left, at_left, at_right


def levenshtein_of(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
    """``edit_distance`` of the pairs ``left[at_left[i]], right[at_right[i]]``: a word per pair holds its row, and a
    step takes one letter of all right texts."""
    texts, at_left, at_right = _one_list(left, right, at_left, at_right)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    size_l, size_r = sizes[at_left], sizes[at_right]
    edits = np.maximum(size_l, size_r)
    open_ = np.minimum(size_l, size_r) > 0
    fits = open_ & (edits <= _BATCH_LETTERS)
    for i in np.flatnonzero(open_ & ~fits).tolist():
        edits[i] = edit_distance(texts[at_left[i]], texts[at_right[i]])
    if not fits.any():
        return edits
    codes, there, letters = _letter_codes([t[:_BATCH_LETTERS] for t in texts], np.minimum(sizes, _BATCH_LETTERS))
    whole = ~there.dtype.type(0)
    first = [whole >> there.dtype.type(8 * there.itemsize - n) if n else 0 for n in range(len(codes) + 1)]
    first = np.array(first, dtype=there.dtype)  # the bits of a text of so many letters
    for size in np.flatnonzero(np.bincount(size_r[fits])).tolist():
        group = np.flatnonzero(fits & (size_r == size))
        for start in range(0, len(group), _SLICE_PAIRS):
            some = group[start:start + _SLICE_PAIRS]
            own, other = at_left[some] * letters, at_right[some]
            up, down = np.full(len(some), whole), np.zeros(len(some), dtype=there.dtype)
            for j in range(size):
                letter = there.take(own + codes[j].take(other))
                level = letter & up
                level += up
                level ^= up
                level |= letter
                level |= down
                ahead = level | up
                np.invert(ahead, out=ahead)
                ahead |= down
                ahead <<= 1
                ahead |= 1
                up &= level
                up <<= 1
                down = level | ahead
                np.invert(down, out=down)
                up |= down
                np.bitwise_and(ahead, level, out=down)
            bits = first[size_l[some]]
            edits[some] = size + np.bitwise_count(up & bits).astype(np.int64) - np.bitwise_count(down & bits)
    return edits


def common_subsequence_batch(left: list[str], right: list[str]) -> np.ndarray:
    """``common_subsequence`` of many pairs of at most 64 letters: a machine word per pair holds its row,
    and a step takes one letter of all right texts (Hyyro, 2004)."""
    a, b = _letters(left), _letters(right)
    count = len(left)
    bit = np.uint64(1) << np.arange(len(a), dtype=np.uint64)
    size_a = np.fromiter(map(len, left), np.uint64, count)
    full = np.where(size_a == 64, ~np.uint64(0), (np.uint64(1) << (size_a & np.uint64(63))) - np.uint64(1))
    row = full.copy()
    for letter in b:
        there = (a == letter) & (letter != 0)
        hits = row & (there * bit[:, None]).sum(axis=0, dtype=np.uint64)
        row = ((row + hits) | (row - hits)) & full
    return (size_a - np.bitwise_count(row)).astype(np.int64)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word row at a time."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hits = row & masks.get(letter, 0)
        row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if not total else 2 * common_subsequence(a, b) / total


def _token_texts(a: str, b: str) -> list[tuple[str, str]] | float:
    """The pairs of texts whose best ratio is that of the word sets, or the ratio where it is known."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_left, only_right = sorted(left - right), sorted(right - left)
    if shared and not (only_left and only_right):
        return 100.0
    with_left = " ".join([shared] * bool(shared) + only_left)
    with_right = " ".join([shared] * bool(shared) + only_right)
    return [(with_left, with_right), *([(shared, with_left), (shared, with_right)] if shared else [])]


def token_set_ratio_text(a: str, b: str) -> float:
    """0..100 similarity of two word sets, whatever the order and the extra words."""
    texts = _token_texts(a, b)
    return texts if isinstance(texts, float) else 100.0 * max(indel_ratio(x, y) for x, y in texts)


def token_set_batch(left: list[str], right: list[str]) -> np.ndarray:
    """``token_set_ratio_text`` of many pairs; texts of at most 64 letters go through one bit-parallel table."""
    known = [_token_texts(a, b) for a, b in zip(left, right)]
    wanted = {pair for texts in known if not isinstance(texts, float) for pair in texts}
    short = [(x, y) for x, y in wanted if x and y and max(len(x), len(y)) <= _BATCH_LETTERS]
    ratio = {pair: indel_ratio(*pair) for pair in wanted.difference(short)}
    for start in range(0, len(short), _BATCH_ROWS):
        some = short[start:start + _BATCH_ROWS]
        lefts, rights = zip(*some)
        shared = common_subsequence_batch(lefts, rights)
        ratio.update((pair, 2 * n / (len(pair[0]) + len(pair[1]))) for pair, n in zip(some, shared.tolist()))
    return np.array([texts if isinstance(texts, float) else 100.0 * max(map(ratio.__getitem__, texts)) for texts in known])


def token_set_of(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
    """``token_set_ratio_text`` of the pairs ``left[at_left[i]], right[at_right[i]]``.

    A text is its words in order, each with a blank behind it, as the bits of a machine word. Of a pair the words that
    both have are taken out; what is left goes through the bit-parallel table of the common subsequence, where letters taken
    out match nothing. The shared words are a common beginning and the last blank a common end, so they count in full.
    """
    texts, at_left, at_right = _one_list(left, right, at_left, at_right)
    words = [sorted(set(text.split())) for text in texts]
    number = {word: i for i, word in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    sizes = np.array([sum(map(len, some)) + len(some) for some in words], dtype=np.int64)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    fits = (sizes <= _BATCH_LETTERS) & (counts <= _BATCH_WORDS)
    score = np.zeros(len(at_left))
    batch = fits[at_left] & fits[at_right]
    for i in np.flatnonzero(~batch).tolist():
        score[i] = token_set_ratio_text(texts[at_left[i]], texts[at_right[i]])
    order = np.flatnonzero(batch & (counts[at_left] > 0) & (counts[at_right] > 0))
    if not len(order):
        return score
    most = int(counts[fits].max())
    numbers = np.full((most, len(texts)), -1, dtype=np.int64)
    places = np.zeros((most, len(texts)), dtype=np.uint64)
    for row in np.flatnonzero(fits).tolist():
        start = 0
        for k, word in enumerate(words[row]):
            end = start + len(word) + 1
            numbers[k, row], places[k, row] = number[word], (1 << end) - (1 << start)
            start = end
    blocks = ["".join(f"{word} " for word in some) if fit else "" for some, fit in zip(words, fits.tolist())]
    codes, there, letters = _letter_codes(blocks, np.where(fits, sizes, 0))
    there = there.astype(np.uint64)
    full = np.bitwise_or.reduce(places, axis=0)
    for start in range(0, len(order), _SLICE_PAIRS):
        some = order[start:start + _SLICE_PAIRS]
        own, other = at_left[some], at_right[some]
        keep_l, keep_r = full[own], full[other]
        shared = np.zeros(len(some), dtype=np.uint64)
        words_l, words_r = int(counts[own].max()), int(counts[other].max())
        for b in range(words_r):
            of_r = numbers[b, other]
            met = np.zeros(len(some), dtype=bool)
            for a in range(words_l):
                same = (numbers[a, own] == of_r) & (of_r >= 0)
                shared |= np.where(same, places[a, own], 0)
                met |= same
            keep_r &= ~np.where(met, places[b, other], 0)
        keep_l &= ~shared
        row = np.full(len(some), ~np.uint64(0))
        base = own * letters
        for j in range(int(sizes[other].max())):
            hits = there.take(base + codes[j].take(other))
            hits &= keep_l
            hits &= row
            hits *= (keep_r >> np.uint64(j)) & np.uint64(1)
            row = (row + hits) | (row - hits)
        common = 64 - np.bitwise_count(row).astype(np.int64)
        both, only_l, only_r = (np.bitwise_count(x).astype(np.int64) for x in (shared, keep_l, keep_r))
        size_l, size_r = both + only_l - 1, both + only_r - 1
        best = 2 * (both + common - 1) / (size_l + size_r)
        begun = both > 0
        for size in (size_l, size_r):
            best = np.maximum(best, np.where(begun, 2 * (both - 1) / np.maximum(both - 1 + size, 1), 0.0))
        score[some] = np.where(begun & ((only_l == 0) | (only_r == 0)), 100.0, 100.0 * best)
    return score


def _distinct_pairs(left: pd.Series, right: pd.Series) -> dict[tuple[str, str], float]:
    """The pairs of a batch without a missing side, each once."""
    return dict.fromkeys(pair for pair in zip(left, right) if pair[0] is not None and pair[1] is not None)


PairScore = Callable[[list[str], list[str], np.ndarray, np.ndarray], np.ndarray]


def _by_distinct_pairs(left: pa.Array, right: pa.Array, score: PairScore) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a batch, and where a side is missing. Only the distinct texts of either side become Python texts, and a
    pair of them that recurs is scored once."""
    missing = np.asarray(left.is_null()) | np.asarray(right.is_null())
    out = np.zeros(len(left))
    if missing.all():
        return out, missing
    coded_l, coded_r = left.dictionary_encode(), right.dictionary_encode()
    at_l, at_r = (np.asarray(c.indices.fill_null(0), dtype=np.int64)[~missing] for c in (coded_l, coded_r))
    pairs, place = np.unique(at_l * len(coded_r.dictionary) + at_r, return_inverse=True)
    known = score(coded_l.dictionary.to_pylist(), coded_r.dictionary.to_pylist(), *np.divmod(pairs, len(coded_r.dictionary)))
    out[~missing] = known[place]
    return out, missing


def _of_unequal(udf: Callable[[Column, Column], Column], left: Column | str, right: Column | str, equal: float) -> Column:
    """``udf`` of two texts; equal ones, whose value is known, are not sent to Python."""
    left, right = (F.col(side) if isinstance(side, str) else side for side in (left, right))
    unequal = left != right
    return F.when(left == right, equal).otherwise(udf(F.when(unequal, left), F.when(unequal, right)))


@F.arrow_udf(T.DoubleType())
def _jaro(left: pa.Array, right: pa.Array) -> pa.Array:
    known, missing = _by_distinct_pairs(left, right, jaro_of)
    return pa.array(known, mask=missing)


@F.arrow_udf(T.DoubleType())
def _jaro_winkler(left: pa.Array, right: pa.Array) -> pa.Array:
    known, missing = _by_distinct_pairs(left, right, winkler_of)
    return pa.array(known, mask=missing)


def jaro_similarity(left: Column | str, right: Column | str) -> Column:
    return _of_unequal(_jaro, left, right, 1.0)


def jaro_winkler_similarity(left: Column | str, right: Column | str) -> Column:
    return _of_unequal(_jaro_winkler, left, right, 1.0)


@cache
def passed_of(thresholds: tuple[float, ...], mark: str | None = None) -> PairScore:
    """The number of the first test that two texts pass, from 1, 0 when none: Jaro-Winkler of the whole texts reaches
    each threshold; then, with a ``mark``, that of what stands before the first one, which is looked at only where needed."""
    def score(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
        first = np.zeros(len(at_left))
        for done in range(1 if mark is None else 2):
            if done:
                left, right = ([text.split(mark, 1)[0] for text in texts] for texts in (left, right))
            known = np.flatnonzero(first == 0)
            known = known[reaches(left, right, at_left[known], at_right[known], min(thresholds))]
            alike = winkler_of(left, right, at_left[known], at_right[known])
            for number, least in reversed(list(enumerate(thresholds, done * len(thresholds) + 1))):
                first[known[alike >= least]] = number
        return first

    return score


@cache
def first_passed(thresholds: tuple[float, ...], mark: str | None = None) -> Callable[[Column, Column], Column]:
    """``passed_of`` of two columns, null when no test is passed."""
    score = passed_of(thresholds, mark)

    @F.arrow_udf(T.IntegerType())
    def passed(left: pa.Array, right: pa.Array) -> pa.Array:
        known, missing = _by_distinct_pairs(left, right, score)
        return pa.array(known.astype(np.int32), mask=missing | (known == 0))

    return passed


def damerau_of(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
    """``damerau`` of the pairs ``left[at_left[i]], right[at_right[i]]``."""
    sizes_l, sizes_r = (np.fromiter(map(len, texts), np.int64, len(texts)) for texts in (left, right))
    size_l, size_r = sizes_l[at_left], sizes_r[at_right]
    edits = np.empty(len(at_left))
    fits = (np.minimum(size_l, size_r) > 0) & (np.maximum(size_l, size_r) <= _BATCH_LETTERS)
    for i in np.flatnonzero(~fits).tolist():
        edits[i] = damerau(left[at_left[i]], right[at_right[i]])
    order = np.flatnonzero(fits)
    order = order[np.argsort(size_l[order] * (_BATCH_LETTERS + 1) + size_r[order], kind="stable")]
    for start in range(0, len(order), _BATCH_ROWS):
        some = order[start:start + _BATCH_ROWS]
        edits[some] = damerau_batch([left[i] for i in at_left[some].tolist()], [right[i] for i in at_right[some].tolist()])
    return edits


@F.arrow_udf(T.IntegerType())
def _damerau(left: pa.Array, right: pa.Array) -> pa.Array:
    known, missing = _by_distinct_pairs(left, right, damerau_of)
    return pa.array(known.astype(np.int32), mask=missing)


def lev_damerau_distance(left: Column | str, right: Column | str) -> Column:
    return _of_unequal(_damerau, left, right, 0)


@F.pandas_udf(T.DoubleType())
def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    known = _distinct_pairs(left, right)
    if known:
        lefts, rights = zip(*known)
        known = dict(zip(known, token_set_batch(lefts, rights).tolist()))
    return pd.Series([known.get(pair) for pair in zip(left, right)], dtype="float64")


def jaccard_of(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
    """Shared share of the character sets of the pairs ``left[at_left[i]], right[at_right[i]]``. A set is a row of bits,
    64 to a word, one for each character of the batch."""
    sets = [[set(text) for text in texts] for texts in (left, right)]
    bit = {letter: i for i, letter in enumerate(set().union(*sets[0], *sets[1]))}
    rows = []
    for side in sets:
        row = np.repeat(np.arange(len(side)), list(map(len, side)))
        place = np.fromiter(map(bit.__getitem__, chain.from_iterable(side)), np.int64, len(row))
        words = np.zeros((len(side), len(bit) // 64 + 1), dtype=np.uint64)
        np.bitwise_or.at(words, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        rows.append(words)
    shared, union = np.zeros(len(at_left), dtype=np.int64), np.zeros(len(at_left), dtype=np.int64)
    for word in range(len(bit) // 64 + 1):
        a, b = rows[0][at_left, word], rows[1][at_right, word]
        shared += np.bitwise_count(a & b)
        union += np.bitwise_count(a | b)
    return shared / np.maximum(union, 1)


@F.arrow_udf(T.DoubleType())
def jaccard_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Shared share of the two character sets; 0 when both are empty."""
    known, missing = _by_distinct_pairs(left, right, jaccard_of)
    return pa.array(known, mask=missing)


# What Spark takes for blanks in a pattern.
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def _word_counts(texts: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and count of every distinct word, text by text, and where each text begins and ends. New words get the
    next numbers."""
    counts = [Counter(filter(None, _BLANKS.split(text))) for text in texts]
    words = [number.setdefault(word, len(number)) for count in counts for word in count]
    times = np.fromiter(chain.from_iterable(count.values() for count in counts), np.int64, len(words))
    return np.array(words, dtype=np.int64), times, np.cumsum([0, *map(len, counts)])


def cosine_of(left: list[str], right: list[str], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
    """1 - cosine of the word counts of the pairs ``left[at_left[i]], right[at_right[i]]``; 1 when either has no words.
    The words of the left text of each pair are looked up among all (text, word) of the right."""
    number: dict[str, int] = {}
    words_l, times_l, ends_l = _word_counts(left, number)
    words_r, times_r, ends_r = _word_counts(right, number)
    squares_l, squares_r = (np.diff(np.concatenate([[0], np.cumsum(times * times)])[ends])
                            for times, ends in ((times_l, ends_l), (times_r, ends_r)))
    found = np.repeat(np.arange(len(right)), np.diff(ends_r)) * len(number) + words_r
    order = np.argsort(found)
    found, times_r = np.append(found[order], -1), np.append(times_r[order], 0)
    many = np.diff(ends_l)[at_left]
    pair = np.repeat(np.arange(len(at_left)), many)
    place = np.arange(len(pair)) + np.repeat(ends_l[at_left] - (np.cumsum(many) - many), many)
    sought = at_right[pair] * len(number) + words_l[place]
    there = np.searchsorted(found[:-1], sought)
    shared = np.where(found[there] == sought, times_l[place] * times_r[there], 0)
    dot = np.bincount(pair, shared, len(at_left))
    aa, bb = squares_l[at_left], squares_r[at_right]
    empty = (aa == 0) | (bb == 0)
    return np.where(empty, 1.0, np.maximum(0.0, 1 - dot / np.where(empty, 1.0, np.sqrt(aa) * np.sqrt(bb))))


@F.arrow_udf(T.DoubleType())
def _cosine_of_lower(left: pa.Array, right: pa.Array) -> pa.Array:
    # long texts go in slices, so that few of them are held as words at once
    size = sum(np.asarray(pc.binary_length(side).fill_null(0), dtype=np.int64) for side in (left, right))
    slices = np.flatnonzero(np.diff(np.cumsum(size) // _SLICE_BYTES, prepend=-1))
    known, missing = zip(*[_by_distinct_pairs(left[start:end], right[start:end], cosine_of)
                           for start, end in zip(slices, [*slices[1:], len(left)])])
    return pa.array(np.concatenate(known), mask=np.concatenate(missing))


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine of the two word-count vectors of the texts in lower case; 1 when either has no words."""
    return _cosine_of_lower(F.lower(left), F.lower(right))


def qgrams(text: Column, q: int) -> Column:
    """All runs of ``q`` letters; an empty array when the text is shorter."""
    last = F.length(text) - q + 1
    return F.when(text.isNull(), None).otherwise(
        F.when(last < 1, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(q)))
        )
    )


def array_pairs(left: Column, right: Column) -> Column:
    """Every pairing of an element of ``left`` with one of ``right``, as arrays."""
    return F.flatten(F.transform(
        left, lambda a: F.transform(right, lambda b: F.array(a, b))
    ))


def coordinate_pairs(left: Column, right: Column) -> Column:
    """Pairings of two lists of ``(lat, lon)`` structs, as structs."""
    return F.flatten(F.transform(
        left, lambda a: F.transform(right, lambda b: F.struct(
            a["lat"].alias("lat_l"), a["lon"].alias("lon_l"),
            b["lat"].alias("lat_r"), b["lon"].alias("lon_r"),
        ))
    ))

"""Pairs of a block compared in Arrow batches, a step over many pairs at a time.

Records are dealt to the blocks they stand in, large blocks as a grid of cells, as in ``blocking``; what is shuffled
are records, not pairs. A task reads its blocks in order, lays the pairs of some of them out as two lists of
row places and works out one column for all of them at once, from codes of the distinct texts. Pairs that
cannot come to the weight asked for are left out before the next, dearer column is looked at, and only pairs
that are kept leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_KM, point_part
from ..functions.similarity import PairScore, levenshtein_of, passed_of
from .blocking import (
    MAX_TASKS, MOST_CELLS, PIECE_PAIRS, PIECE_ROWS, BlockingRule, _in_cells, _large_blocks, block_sizes, cost_rules, keyed,
    rule_columns,
)
from .compare import Comparison, _iso_date
from .skew import in_small_tasks, skew_join

# Pairs of a task and of a step of it. A step holds some hundred bytes a pair.
CELL_TASK_PAIRS, STEP_PAIRS = 1_000_000, 1 << 18
# Rows in order of which one cell finds the neighbours.
ORDERED_ROWS = 1_000
# Patterns of levels are counted in an array of this many at most.
MOST_CODES = 1 << 22
# Texts of a column are compared by pairs of distinct ones where those are at most this many times the pairs.
_TABLE_SHARE = 4
# From the cheapest to the dearest.
_KINDS = ("exact", "postcode", "distance", "levenshtein", "birth_date", "jaro_winkler", "email")
_ARROW = {"int": pa.int32(), "double": pa.float64()}


@dataclass(frozen=True)
class Measure:
    """A number for each pair, worked out by ``score`` from the texts of one column; null where a side is."""

    name: str
    column: str
    score: PairScore
    type: str = "double"


@dataclass(frozen=True)
class Bound:
    """Pairs below the weight ``least`` may be left out: ``prior`` plus, for each comparison, the weight of
    its level (missing first) and on equality the log2 of ``usual`` over the frequency of the value, the larger one of
    the sides ``tf``."""

    least: float
    prior: float
    weights: dict[str, list[float]]
    usual: dict[str, float]
    tf: tuple[str, ...] = ("l", "r")


def agreeing(comparison: Comparison) -> Bound:
    """The bound that leaves out pairs of level 0 and with a side missing."""
    return Bound(0.5, 0.0, {comparison.column: [0.0, 0.0, *[1.0] * comparison.top]}, {})


def comparable(df: DataFrame, comparisons: Iterable[Comparison]) -> bool:
    """Whether the comparisons can be worked out here: texts, of the kinds that are known."""
    plain = {f.name for f in df.schema if f.dataType == T.StringType()}
    return all(c.column in plain and c.kind in _KINDS and (c.kind in ("exact", "birth_date") or bool(c.thresholds))
               and all(t >= 0 for t in c.thresholds) for c in comparisons)


class _Texts:
    """A column of the rows at hand as codes of its distinct texts, -1 for a missing one."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode()
        self.codes = np.asarray(coded.indices.fill_null(-1), dtype=np.int64)
        self.values = coded.dictionary
        self._list: list[str] | None = None

    @property
    def texts(self) -> list[str]:
        if self._list is None:
            self._list = self.values.to_pylist()
        return self._list

    def of_pairs(self, at_left: np.ndarray, at_right: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """``score`` of pairs of codes, each pair of them once where distinct texts are few next to the pairs."""
        count = len(self.values)
        if count * count > _TABLE_SHARE * len(at_left):
            return score(at_left, at_right)
        cell = at_left * count + at_right
        seen = np.zeros(count * count, dtype=bool)
        seen[cell] = True
        pairs = np.flatnonzero(seen)
        known = score(*np.divmod(pairs, count))
        table = np.zeros(count * count, dtype=known.dtype)
        table[pairs] = known
        return table[cell]


def _measured(texts: _Texts, at_left: np.ndarray, at_right: np.ndarray, score: PairScore) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of rows, and where a side is missing."""
    left, right = texts.codes[at_left], texts.codes[at_right]
    there = (left >= 0) & (right >= 0)
    found = np.zeros(len(left))
    if there.any():
        found[there] = texts.of_pairs(left[there], right[there], lambda a, b: score(texts.texts, texts.texts, a, b))
    return found, ~there


def _date_levels(c: Comparison, texts: _Texts, days: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``days``: of the distinct texts, nan for no date."""
    def score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        known = texts.texts
        apart = np.abs(days[left] - days[right])
        level = np.zeros(len(left), dtype=np.int8)
        for i, most in reversed(list(enumerate(c.thresholds))):
            level[apart <= int(most)] = c.top - 2 - i
        edits = levenshtein_of(known, known, left, right)
        level[edits <= 1] = c.top - 1
        for i in np.flatnonzero(edits == 2).tolist():
            a, b = known[left[i]], known[right[i]]
            if len(a) == len(b):
                at = next(k for k, (x, y) in enumerate(zip(a, b)) if x != y)
                if a[at + 1:at + 2] + a[at] + a[at + 2:] == b[at:]:
                    level[i] = c.top - 1
        return level

    return score


def _distance_levels(c: Comparison, lat: np.ndarray, lon: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``lat``, ``lon``: of the distinct texts, nan for no place."""
    lat, lon = np.radians(lat), np.radians(lon)
    narrow = np.cos(lat)

    def score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = np.sin((lat[right] - lat[left]) / 2) ** 2 + narrow[left] * narrow[right] * np.sin((lon[right] - lon[left]) / 2) ** 2
        apart = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        level = np.zeros(len(left), dtype=np.int8)
        for i, most in reversed(list(enumerate(c.thresholds))):
            level[apart <= float(most)] = c.top - 1 - i
        return level

    return score


def _numbers(rows: pa.Table, texts: _Texts, column: str) -> np.ndarray:
    """What a column of the rows says of each distinct text, nan for nothing."""
    found = np.full(len(texts.values), np.nan)
    there = texts.codes >= 0
    of_rows = np.asarray(rows[column].combine_chunks().cast(pa.float64()).fill_null(np.nan))
    found[texts.codes[there]] = of_rows[there]
    return found


@cache
def _first_passed(c: Comparison) -> PairScore:
    return passed_of(c.thresholds, "@" if c.kind == "email" else None)


def _unequal_levels(c: Comparison, rows: pa.Table, texts: _Texts) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The level of two different texts, by their codes: as ``compare.gamma``."""
    if c.kind == "exact":
        return lambda left, right: np.zeros(len(left), dtype=np.int8)
    if c.kind == "postcode":
        begun = [np.asarray(pc.utf8_slice_codeunits(texts.values, 0, int(n)).dictionary_encode().indices) for n in c.thresholds]
        return lambda left, right: np.select(
            [codes[left] == codes[right] for codes in begun], [c.top - 1 - i for i in range(len(begun))], 0).astype(np.int8)
    if c.kind == "levenshtein":
        steps = np.array([c.top - 1 - i for i in range(len(c.thresholds))] + [0], dtype=np.int8)
        most = np.array([int(t) for t in c.thresholds])
        return lambda left, right: steps[np.searchsorted(most, levenshtein_of(texts.texts, texts.texts, left, right))]
    if c.kind == "birth_date":
        return _date_levels(c, texts, _numbers(rows, texts, f"_days_{c.column}"))
    if c.kind == "distance":
        return _distance_levels(c, _numbers(rows, texts, f"_lat_{c.column}"), _numbers(rows, texts, f"_lon_{c.column}"))
    tests = len(c.thresholds) * (2 if c.kind == "email" else 1)
    levels = np.array([0, *(c.top - n - (c.kind == "email") for n in range(1, tests + 1))])
    levels = np.maximum(levels, 0).astype(np.int8)

    def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return levels[_first_passed(c)(texts.texts, texts.texts, left, right).astype(np.int64)]

    if c.kind == "jaro_winkler":
        return alike
    users = np.asarray(pa.array([text.split("@", 1)[0] for text in texts.texts], pa.string()).dictionary_encode().indices)

    def of_email(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        level = np.full(len(left), c.top - 1, dtype=np.int8)
        other = np.flatnonzero(users[left] != users[right])
        level[other] = alike(left[other], right[other])
        return level

    return of_email


class _Step:
    """Some pairs of the rows at hand: the places of their ends, and what is known of them."""

    def __init__(self, rows: pa.Table, at_left: np.ndarray, at_right: np.ndarray):
        self.rows, self.left, self.right = rows, at_left, at_right
        self.found: dict[str, np.ndarray] = {}
        self._texts: dict[str, _Texts] = {}

    def texts(self, column: str) -> _Texts:
        if column not in self._texts:
            self._texts[column] = _Texts(self.rows[column].combine_chunks())
        return self._texts[column]

    def keep(self, some: np.ndarray) -> None:
        if not some.all():
            self.left, self.right = self.left[some], self.right[some]
            self.found = {name: values[some] for name, values in self.found.items()}

    def sides(self, column: str) -> tuple[np.ndarray, np.ndarray]:
        codes = self.texts(column).codes
        return codes[self.left], codes[self.right]

    def level(self, c: Comparison) -> np.ndarray:
        left, right = self.sides(c.column)
        level = np.where(left == right, np.int8(c.top), np.int8(0))
        level[(left < 0) | (right < 0)] = -1
        open_ = np.flatnonzero(level == 0)
        if len(open_) and c.kind != "exact":
            texts = self.texts(c.column)
            level[open_] = texts.of_pairs(left[open_], right[open_], _unequal_levels(c, self.rows, texts))
        return level

    def rarity(self, c: Comparison, bound: Bound) -> np.ndarray:
        """What equality of a value adds by its frequency; nan where that is not known."""
        ends = {"l": self.left, "r": self.right}
        values = np.asarray(self.rows[f"tf_{c.column}"].combine_chunks().cast(pa.float64()).fill_null(np.nan))
        common = values[ends[bound.tf[0]]]
        for end in bound.tf[1:]:
            common = np.fmax(common, values[ends[end]])
        with np.errstate(divide="ignore"):
            return np.log2(bound.usual[c.column] / common)

    def compare(self, comparisons: list[Comparison], bound: Bound | None) -> None:
        """The levels of all comparisons; with a bound, of the pairs that can come to it, the dearest comparisons last."""
        if bound is None:
            for c in comparisons:
                self.found[c.gamma] = self.level(c)
            return
        highest = np.full(len(self.left), bound.prior + 1e-6)  # sums in another order differ in the last digits
        for c in comparisons:
            left, right = self.sides(c.column)
            weights = bound.weights[c.column]
            best = np.where(left == right, weights[-1], max(weights[1:-1]))
            if c.term_frequency:
                best += np.where(left == right, self.rarity(c, bound), 0.0)
            best[(left < 0) | (right < 0)] = weights[0]
            self.found[f"_best_{c.column}"] = best
            highest += best
        self.found["_highest"] = highest
        for c in sorted(comparisons, key=lambda c: _KINDS.index(c.kind)):
            self.keep(~(self.found["_highest"] < bound.least))  # what cannot be told stays
            level = self.level(c)
            exact = np.array(bound.weights[c.column])[level.astype(np.int64) + 1]
            if c.term_frequency:
                exact += np.where(level == c.top, self.rarity(c, bound), 0.0)
            self.found["_highest"] = self.found["_highest"] + (exact - self.found.pop(f"_best_{c.column}"))
            self.found[c.gamma] = level
        self.keep(~(self.found["_highest"] < bound.least))


def _of_a_kind(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal for equal values next to each other; nulls are equal."""
    value = column.combine_chunks()
    if not len(value):
        return np.zeros(0, dtype=np.int64)
    coded = value.dictionary_encode(null_encoding="encode")
    return np.asarray(coded.indices, dtype=np.int64)


_PLACE = ("rule_no", "block_key", "_cell_l", "_cell_r")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables that end where a cell ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        differs = np.zeros(table.num_rows - 1, dtype=bool)
        for name in _PLACE:
            codes = _of_a_kind(table[name])
            differs |= codes[:-1] != codes[1:]
        ends = np.flatnonzero(differs)
        if len(ends):
            cut = int(ends[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _meetings(rows: pa.Table, links: bool, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of the first row it meets, and how many: those behind it in its cell, or, where a cell
    has two sides, those of the second side. A row of the first side may meet its next ``neighbours`` only."""
    count = rows.num_rows
    change = np.zeros(count, dtype=bool)
    change[0] = True
    for name in _PLACE:
        codes = _of_a_kind(rows[name])
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    cell = np.cumsum(change) - 1
    ends = np.append(starts[1:], count)[cell]
    second = np.asarray(rows["_side"].combine_chunks(), dtype=np.int64) > 0
    if neighbours:
        begin = np.arange(count) + 1
        return begin, np.where(second, 0, np.minimum(ends - begin, neighbours))
    # rows of the second side stand last in a cell
    firsts = np.bincount(cell, ~second, len(starts)).astype(np.int64)
    middle = (starts + firsts)[cell]
    place = np.arange(count)
    if links:
        apart = np.ones(count, dtype=bool)
    else:
        cells = [np.asarray(rows[name].combine_chunks(), dtype=np.int64) for name in _PLACE[2:]]
        apart = cells[0] != cells[1]
    begin = np.where(apart, middle, place + 1)
    return begin, np.where(apart & second, 0, ends - begin)


def _steps(rows: pa.Table, links: bool, pairs: int, neighbours: int = 0) -> Iterator[_Step]:
    """The pairs of the rows, some ``pairs`` at a time, each with the rows that it needs."""
    begin, many = _meetings(rows, links, neighbours)
    upto = np.cumsum(many)
    first = 0
    while first < len(many):
        done = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, done + pairs, side="right")), first + 1)
        own = many[first:last]
        total = int(own.sum())
        if total:
            met = np.flatnonzero(own)
            upper = int((begin[first:last] + own)[met].max())
            left = np.repeat(np.arange(last - first), own)
            right = np.arange(total) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[first:last] - first, own)
            yield _Step(rows.slice(first, upper - first), left, right)
        first = last


def _order(rows: pa.Table, key: str) -> np.ndarray:
    """The place of each row's key among all keys in order, -1 for a missing one."""
    coded = rows[key].combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    rank[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(rank))
    codes = np.asarray(coded.indices.fill_null(-1), dtype=np.int64)
    return np.where(codes < 0, -1, rank[codes]) if len(rank) else codes


def _ends_in_order(step: _Step, key: str) -> None:
    """Pairs of different keys, the lower one on the left."""
    order = _order(step.rows, key)
    left, right = order[step.left], order[step.right]
    lower = left < right
    step.left, step.right = np.where(lower, step.left, step.right), np.where(lower, step.right, step.left)
    step.keep((left != right) & (left >= 0) & (right >= 0))


def _under_first_rule(step: _Step, rules: int) -> None:
    """Leave out pairs that an earlier rule brings too."""
    numbers = np.asarray(step.rows["rule_no"].combine_chunks(), dtype=np.int64)
    for earlier in range(min(rules - 1, int(numbers.max()))):
        left, right = step.sides(f"_key_{earlier}")
        step.keep((numbers[step.left] <= earlier) | (left < 0) | (left != right))


def _numbered_blocks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the blocks of each row (a column), -1 where it has fewer, and of the one that it stands in, in order."""
    lists = rows["_blocks"].combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
    coded = pa.concat_arrays([lists.flatten(), rows["block_key"].combine_chunks()]).dictionary_encode()
    order = np.empty(len(coded.dictionary), dtype=np.int64)
    order[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(order))
    codes = order[np.asarray(coded.indices)]
    row = np.repeat(np.arange(len(lists)), sizes)
    numbers = np.full((int(sizes.max(initial=0)), len(lists)), -1, dtype=np.int64)
    numbers[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = codes[:len(row)]
    return numbers, codes[len(row):]


def _without_shared(step: _Step, lower: bool) -> None:
    """Leave out pairs whose rows share a block, or with ``lower`` one of a lower number than that in which they meet."""
    numbers, own = _numbered_blocks(step.rows)
    if lower:
        numbers = np.where(numbers < own, numbers, -1)
        numbers = numbers[(numbers >= 0).any(axis=1)]
    met = np.zeros(len(step.left), dtype=bool)
    of_right = [block[step.right] for block in numbers]
    for block in numbers:
        of_left = block[step.left]
        for other in of_right:
            met |= (of_left == other) & (other >= 0)
    step.keep(~met)


def _near_in_order(step: _Step, key: str, side: str | None) -> None:
    """The lower key on the left; with ``side``, only pairs of both sides, the one where it is false on the left."""
    if side:
        later = np.asarray(step.rows[side].combine_chunks().cast(pa.int8()))
        step.keep(later[step.left] != later[step.right])
        first = later[step.left] == 0
    else:
        order = _order(step.rows, key)
        first = (order[step.left] >= 0) & (order[step.left] < order[step.right])
    step.left, step.right = np.where(first, step.left, step.right), np.where(first, step.right, step.left)


@dataclass(frozen=True)
class _Work:
    """What a task does with its cells."""

    rules: int
    key: str
    columns: tuple[str, ...]
    comparisons: tuple[Comparison, ...]
    measures: tuple[Measure, ...]
    links: bool
    every_rule: bool
    bound: Bound | None
    counted: str | None
    blocks: bool = False
    neighbours: int = 0
    side: str | None = None

    def steps(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Step]:
        for rows in _whole_cells(batches):
            for step in _steps(rows, self.links, STEP_PAIRS, self.neighbours):
                if self.neighbours:
                    _near_in_order(step, self.key, self.side)
                elif not self.links:
                    _ends_in_order(step, self.key)
                if self.blocks and len(step.left):
                    _without_shared(step, not self.neighbours)
                elif not self.every_rule and len(step.left):
                    _under_first_rule(step, self.rules)
                step.compare(list(self.comparisons), self.bound)
                yield step

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in self.steps(batches):
            if not len(step.left):
                continue
            found = {"rule_no": step.rows["rule_no"].combine_chunks().take(pa.array(step.left))}
            for end, places in (("l", pa.array(step.left)), ("r", pa.array(step.right))):
                found |= {f"{c}_{end}": step.rows[c].combine_chunks().take(places) for c in self.columns}
            found |= {c.gamma: pa.array(step.found[c.gamma].astype(np.int32)) for c in self.comparisons}
            for m in self.measures:
                values, missing = _measured(step.texts(m.column), step.left, step.right, m.score)
                found[m.name] = pa.array(values, mask=missing).cast(_ARROW[m.type])
            yield pa.RecordBatch.from_pydict(found)

    def patterns(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rule_no, levels, pairs): pairs with equal levels are counted, by the product of what ``counted`` says."""
        for step in self.steps(batches):
            if not len(step.left):
                continue
            numbers = np.asarray(step.rows["rule_no"].combine_chunks(), dtype=np.int64)
            levels = [numbers[step.left], *(step.found[c.gamma].astype(np.int64) + 1 for c in self.comparisons)]
            code, codes = np.zeros(len(step.left), dtype=np.int64), 1
            for level, size in zip(levels, [self.rules, *(c.top + 2 for c in self.comparisons)]):
                if codes * size > MOST_CODES:  # number only those that there are
                    code = np.unique(code, return_inverse=True)[1]
                    codes = int(code.max()) + 1
                code, codes = code * size + level, codes * size
            copies = np.asarray(step.rows[self.counted].combine_chunks(), dtype=np.int64)
            pairs = np.bincount(code, copies[step.left] * copies[step.right], codes).astype(np.int64)
            one = np.full(codes, -1, dtype=np.int64)
            one[code] = np.arange(len(code))  # any pair of a code tells its levels
            at = np.flatnonzero(one >= 0)
            found = {name: pa.array(level[one[at]].astype(np.int32) - less) for name, level, less in zip(
                ["rule_no", *(c.gamma for c in self.comparisons)], levels, [0, *[1] * len(self.comparisons)])}
            yield pa.RecordBatch.from_pydict(found | {"pairs": pa.array(pairs[at])})


def cell_tasks(pairs: int) -> int:
    """Number of tasks for that many pairs."""
    return min(max(pairs // CELL_TASK_PAIRS, 1), MAX_TASKS)


def _carried(work: _Work) -> tuple[list[str], list[Column]]:
    """The columns that a record brings along, and its dates and places as numbers."""
    frequencies = [f"tf_{c.column}" for c in work.comparisons if c.term_frequency and work.bound]
    columns = [*work.columns, *(c.column for c in work.comparisons), *(m.column for m in work.measures), *frequencies]
    columns = list(dict.fromkeys([*columns, *([work.counted] if work.counted else [])]))
    numbers = []
    for column, kind in dict.fromkeys((c.column, c.kind) for c in work.comparisons):
        text = F.col(column)
        if kind == "birth_date":
            numbers.append(F.unix_date(_iso_date(text)).alias(f"_days_{column}"))
        if kind == "distance":  # a record may meet none, so what is no place is no error
            numbers += [point_part(text, i, True).alias(f"_{part}_{column}") for i, part in enumerate(("lat", "lon"))]
    return columns, numbers


def _dealt(df: DataFrame, rules: list[BlockingRule], work: _Work, count: int | None = None) -> DataFrame:
    """A row per record and rule, with the keys under all rules but the last."""
    columns, numbers = _carried(work)
    earlier = [F.get("_keys", F.lit(i)).alias(f"_key_{i}") for i in range(0 if work.every_rule else len(rules) - 1)]
    needed = list(dict.fromkeys([*columns, *rule_columns(rules)]))
    rows = keyed(in_small_tasks(df.select(*needed), len(rules), count), rules)
    return rows.select("rule_no", "block_key", *columns, *earlier, *numbers)


def _in_half_cells(rows: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """Rows in the cells on one side of the grid of their block, for its pairs without order: a row stands in a
    stripe and goes to the cells of it and each other stripe."""
    rows = skew_join(rows, large, ["rule_no", "block_key"], "block_rows", "left")
    stripes = F.coalesce("_stripes_l", F.lit(1).cast("bigint"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(key), stripes)).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("bigint"), stripes - 1)))
    return rows.withColumns({
        "_cell_l": F.least("_own", "_other"), "_cell_r": F.greatest("_own", "_other"),
        "_side": (F.col("_own") > F.col("_other")).cast("int"),
    }).drop("_own", "_other", "_stripes_l", "_stripes_r", "block_rows")


def _in_one_cell(rows: DataFrame) -> DataFrame:
    nothing = F.lit(0).cast("bigint")
    return rows.withColumns({"_cell_l": nothing, "_cell_r": nothing, "_side": F.lit(0)})


def _worked(rows: DataFrame, work: _Work, tasks: int) -> DataFrame:
    """``work`` done on the rows, dealt to tasks by cell and sorted by cell and side."""
    types = {f.name: f.dataType for f in rows.schema}
    ready = rows.repartition(tasks, *_PLACE).sortWithinPartitions(*_PLACE, "_side", *(["_place"] if work.neighbours else []))
    gammas = [T.StructField(c.gamma, T.IntegerType()) for c in work.comparisons]
    number = T.StructField("rule_no", T.IntegerType())
    if work.counted:
        return ready.mapInArrow(work.patterns, T.StructType([number, *gammas, T.StructField("pairs", T.LongType())]))
    ends = [T.StructField(f"{c}_{end}", types[c]) for end in "lr" for c in work.columns]
    measures = [T.StructField(m.name, T.IntegerType() if m.type == "int" else T.DoubleType()) for m in work.measures]
    return ready.mapInArrow(work.pairs, T.StructType([number, *ends, *gammas, *measures]))


def compared_pairs(df: DataFrame, rules: list[BlockingRule], comparisons: list[Comparison] = (), columns: list[str] = (),
                   key: str = "unique_id", largest_block: int | None = None, pairs: int | None = None, every_rule: bool = False,
                   bound: Bound | None = None, measures: list[Measure] = (), counted: str | None = None,
                   piece_pairs: int = PIECE_PAIRS) -> DataFrame:
    """The pairs of ``blocking.block_pairs`` with the levels of ``compare.compare_pairs`` and the ``measures``. The
    ``columns`` of both ends come along; those that are compared do not, if they are not among them. With ``bound``,
    pairs that cannot come to it are left out. With ``counted``, a column of whole numbers, pairs of equal levels
    are counted by its product: (rule_no, levels, pairs), a row or more for each."""
    work = _Work(len(rules), key, tuple(dict.fromkeys([key, *columns])), tuple(comparisons), tuple(measures), False,
                 every_rule, bound, counted)
    if largest_block is None or pairs is None:
        costs = cost_rules(df, rules)
        largest_block = max(c.largest_block for c in costs) if largest_block is None else largest_block
        pairs = sum(c.comparisons for c in costs) if pairs is None else pairs
    rows = _dealt(df, rules, work, df.count())
    if largest_block**2 > piece_pairs:
        piece_pairs = max(piece_pairs, 2 * pairs // MOST_CELLS)
        sizes = block_sizes(df, rules).select(
            "rule_no", "block_key", F.col("block_rows").alias("rows_l"), F.col("block_rows").alias("rows_r"))
        rows = _in_half_cells(rows, _large_blocks(sizes, max(isqrt(piece_pairs), 1)), key)
    else:
        rows = _in_one_cell(rows)
    return _worked(rows, work, cell_tasks(pairs))


def compared_links(new: DataFrame, base: DataFrame, rules: list[BlockingRule], comparisons: list[Comparison],
                   columns: list[str] = (), key: str = "unique_id", bound: Bound | None = None, measures: list[Measure] = (),
                   piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The pairs of ``blocking.block_links``, base records on the left, as ``compared_pairs``."""
    work = _Work(len(rules), key, tuple(dict.fromkeys([key, *columns])), tuple(comparisons), tuple(measures), True, False, bound, None)
    sizes = block_sizes(base, rules).withColumnRenamed("block_rows", "rows_l").join(
        block_sizes(new, rules).withColumnRenamed("block_rows", "rows_r"), ["rule_no", "block_key"])
    large = _large_blocks(sizes, piece_rows)
    cells = not large.isEmpty()
    sides = []
    for number, (side, own, other) in enumerate(((base, "l", "r"), (new, "r", "l"))):
        rows = _dealt(side, rules, work)
        if cells:
            rows = _in_cells(rows, large, key, own, other).withColumn("_side", F.lit(number))
        else:
            rows = _in_one_cell(rows).withColumn("_side", F.lit(number))
        sides.append(rows)
    met = F.col("rows_l").cast("decimal(19,0)") * F.col("rows_r")
    pairs = int(sizes.agg(F.sum(met)).first()[0] or 0)
    return _worked(sides[0].unionByName(sides[1]), work, cell_tasks(pairs))


def compared_members(rows: DataFrame, comparisons: list[Comparison], columns: list[str], pairs: int, key: str = "unique_id",
                     side: str | None = None, bound: Bound | None = None) -> DataFrame:
    """Pairs of ``rows`` that share any of their ``_blocks``, numbers of blocks of a few rows, each pair once; with ``side`` as
    ``refine.refined_pairs``. ``pairs``: about how many there are. Levels, columns and bound as ``compared_pairs``."""
    work = _Work(1, key, tuple(dict.fromkeys([key, *columns])), tuple(comparisons), (), side is not None, True, bound, None, True)
    columns, numbers = _carried(work)
    spread = _in_one_cell(rows.withColumn("block_key", F.explode("_blocks")).select(
        F.lit(0).alias("rule_no"), "block_key", "_blocks", *dict.fromkeys([*columns, *([side] if side else [])]), *numbers))
    if side:
        spread = spread.withColumn("_side", F.col(side).cast("int"))
    return _worked(spread, work, cell_tasks(pairs)).drop("rule_no")


def compared_neighbours(rows: DataFrame, comparisons: list[Comparison], columns: list[str], neighbours: int, key: str = "unique_id",
                        side: str | None = None, bound: Bound | None = None) -> DataFrame:
    """Pairs of ``rows`` at most ``neighbours`` apart by their ``_place`` in their ``_block`` that share none of their ``_blocks``;
    a pair may come from several. A cell holds a stretch of the order and the first rows of the next."""
    work = _Work(1, key, tuple(dict.fromkeys([key, *columns])), tuple(comparisons), (), False, True, bound, None, True, neighbours, side)
    carried, numbers = _carried(work)
    stretch, place = F.floor((F.col("_place") - 1) / ORDERED_ROWS), F.pmod(F.col("_place") - 1, F.lit(ORDERED_ROWS))
    behind = F.when((stretch > 0) & (place < neighbours), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    spread = rows.select(
        F.lit(0).alias("rule_no"), F.col("_block").alias("block_key"), "_blocks", "_place", F.explode(behind).alias("_cell_l"),
        stretch.alias("_cell_r"), *dict.fromkeys([*carried, *([side] if side else [])]), *numbers)
    spread = spread.withColumn("_side", (F.col("_cell_l") != F.col("_cell_r")).cast("int")).withColumn("_cell_r", F.col("_cell_l"))
    return _worked(spread, work, cell_tasks(rows.count() * neighbours)).drop("rule_no")

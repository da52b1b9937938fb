"""The match model of Fellegi and Sunter (1969): estimate, train, score."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_share
from .blocking import (
    BlockingRule, RuleCost, block_pairs, cost_rules, keyed, matched_pairs, rule_columns, tasks_for,
)
from .cells import Bound, comparable, compared_pairs
from .compare import (
    DEAR_KINDS, LATER_KINDS, Comparison, compare_pairs, compared_columns, email_user, gamma, self_levels,
)
from .dedupe import find_copies
from .numbering import dense_number
from .prior import column_source, recaptured_prior
from .profile import sample_rows
from .refine import Refinement, compared_refined, refined_pairs
from .scratch import forget, materialize
from .skew import in_small_tasks

# Sizes and stopping rules of training.
TRAINING_PAIRS = 2_000_000  # expected pairs of a rule that training compares
RANDOM_PAIRS = 2_000_000
RECALLS = (0.95, 1.0)
CONVERGENCE, MAX_ROUNDS = 0.001, 25

# Random pairs come from at most this many records, each paired with several others.
PAIRED_RECORDS = 100_000
# Up to this many patterns EM runs on the driver, a few megabytes; beyond, each round is a job.
MOST_PATTERNS = 200_000
# A comparison is trained by this many rules that leave it open, where there are as many.
RULES_PER_COMPARISON = 3
_FLOOR = 1e-6
# A training sample consists of at least about this many pieces of blocks.
_LEAST_PIECES = 64
_TOP_START = 0.95


@dataclass
class Settings:
    comparisons: list[Comparison]
    rules: list[BlockingRule]
    convergence: float = CONVERGENCE
    max_rounds: int = MAX_ROUNDS
    keep_levels: bool = False


@dataclass
class Model:
    """``m`` and ``u`` hold one probability per level, from 0 to the top.

    What training found out about itself: ``trained`` and ``untrained`` comparisons (the latter
    keep the start values), the standard error of u per level, and per rule the pairs
    compared, the share of its blocks they come from, the rounds and whether they settled.
    """

    prior: float
    comparisons: list[Comparison]
    m: dict[str, list[float]]
    u: dict[str, list[float]]
    rules: list[BlockingRule] = field(default_factory=list)
    trained: list[str] = field(default_factory=list)
    untrained: list[str] = field(default_factory=list)
    u_error: dict[str, list[float]] = field(default_factory=dict)
    runs: list[dict] = field(default_factory=list)

    def weights(self, c: Comparison) -> list[float]:
        """log2(m / u) per level, with 0 in front for a missing side."""
        pairs = zip(self.m[c.column], self.u[c.column])
        return [0.0, *(math.log2(max(m, _FLOOR) / max(u, _FLOOR)) for m, u in pairs)]

    @property
    def prior_weight(self) -> float:
        p = min(max(self.prior, 1e-12), 1 - 1e-9)
        return math.log2(p / (1 - p))

    def to_dict(self) -> dict:
        return {
            "prior": self.prior,
            "comparisons": [c.to_dict() for c in self.comparisons],
            "m": self.m, "u": self.u, "trained": self.trained,
            "untrained": self.untrained, "u_error": self.u_error, "runs": self.runs,
            "rules": [{"name": r.name, "columns": list(r.columns)} for r in self.rules],
        }

    @staticmethod
    def from_dict(fields: dict) -> Model:
        return Model(
            fields["prior"], [Comparison.from_dict(c) for c in fields["comparisons"]],
            fields["m"], fields["u"],
            [BlockingRule(r["name"], tuple(r["columns"])) for r in fields["rules"]],
            fields["trained"], fields.get("untrained", []), fields.get("u_error", {}),
            fields.get("runs", []),
        )


# ---------------------------------------------------------------- prior


def estimate_prior(df: DataFrame, rules: list[BlockingRule], recall: float,
                   rows: int | None = None) -> float:
    """Probability that two random records match: pairs brought by rules taken as certain,
    over the share of all matches they are believed to find."""
    rows = df.count() if rows is None else rows
    possible = rows * (rows - 1) / 2
    prior = matched_pairs(df, rules) / recall / possible if possible else 0.0
    if prior > 1:
        raise ValueError("the rules match more pairs than the recall allows")
    return prior


def prior_with_fallback(df: DataFrame, rules: list[BlockingRule], rows: int) -> float:
    """Recall 0.95, then 1.0; without any matched pair, one duplicate per record."""
    for recall in RECALLS:
        try:
            prior = estimate_prior(df, rules, recall, rows)
        except ValueError:
            continue
        if prior > 0:
            return prior
    return 1 / max(rows - 1, 1)


# ---------------------------------------------------------------- u


def random_pairs(df: DataFrame, columns: list[str], rows: int, max_pairs: int = RANDOM_PAIRS,
                 key: str = "unique_id", paired_records: int = PAIRED_RECORDS) -> DataFrame:
    """At most about ``max_pairs`` pairs of different records, all of them if they are few, from
    about ``paired_records`` records at most.

    Records stand on a ring in hash order and each meets the next few: an equality join on
    ring places, so no cross join and an even number of pairs for every record.
    """
    carried = list(dict.fromkeys([key, *columns]))
    sample = sample_rows(df.select(*carried), key, paired_records, rows)
    ring = dense_number(sample, [hash_share(F.col(key)), F.col(key)], "_place")
    size = ring.count()
    everything = size * (size - 1) // 2 <= max_pairs
    steps = size - 1 if everything else max(max_pairs // size, 1)
    if size < 2:
        steps = 1
    left = ring.select(*[F.col(c).alias(f"{c}_l") for c in carried], F.col("_place").alias("_at"))
    right = ring.select(*[F.col(c).alias(f"{c}_r") for c in carried], F.col("_place").alias("_to"))
    last = F.least(F.lit(size) - F.col("_at"), F.lit(steps)) if everything else F.lit(steps)
    step = F.explode(F.when(last >= 1, F.sequence(F.lit(1).cast("bigint"), last.cast("bigint"))))
    target = F.pmod(F.col("_at") - 1 + F.col("_step"), F.lit(size)) + 1
    tasks = tasks_for(min(max_pairs, size * (size - 1) // 2))
    # both sides are cut alike, so the join adds no exchange and keeps the number of tasks
    return (left.withColumn("_step", step).withColumn("_to", target).repartition(tasks, "_to")
            .join(right.repartition(tasks, "_to").hint("shuffle_hash"), "_to")
            .drop("_to", "_at", "_step"))


def level_counts(compared: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """(comparison, level, pairs): one row per level, from a single aggregated row."""
    sums = [
        F.struct(F.lit(c.column).alias("comparison"), F.lit(level).alias("level"),
                 F.count_if(F.col(c.gamma) == level).alias("pairs"))
        for c in comparisons for level in range(c.top + 1)
    ]
    return compared.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def estimate_u(df: DataFrame, comparisons: list[Comparison], rows: int,
               max_pairs: int = RANDOM_PAIRS, key: str = "unique_id",
               paired_records: int = PAIRED_RECORDS) -> DataFrame:
    """(comparison, level, pairs, u, u_error): how often random records agree that well, and
    the standard error that the number of pairs leaves; more ``max_pairs`` make it smaller."""
    columns = [c.column for c in comparisons]
    pairs = random_pairs(df, columns, rows, max_pairs, key, paired_records)
    counts = level_counts(compare_pairs(pairs, comparisons), comparisons)
    totals = counts.groupBy("comparison").agg(F.sum("pairs").alias("_all"))
    u = F.when(F.col("_all") > 0, F.col("pairs") / F.col("_all")).otherwise(0.0)
    error = F.sqrt(F.col("u") * (1 - F.col("u")) / F.col("_all"))
    return counts.join(F.broadcast(totals), "comparison").withColumn("u", u).select(
        "comparison", "level", "pairs", "u",
        F.when(F.col("_all") > 0, error).otherwise(1.0).alias("u_error"))


def equality_u(df: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """(comparison, filled, equal_pairs, u): how often two different filled records are equal, exact,
    from the frequencies of all values: the pairs of equal values over all pairs. One job for
    all comparisons; no pair is formed and nothing sampled."""
    return _equality(df, [c.column for c in comparisons])


def _equality(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("comparison"), F.col(c).cast("string").alias("value")) for c in columns]
    rows = in_small_tasks(df.select(*dict.fromkeys(columns)), len(cells))
    values = rows.select(F.inline(F.array(*cells))).where("value IS NOT NULL").groupBy("comparison", "value").agg(
        F.count("*").alias("n"))
    n = F.col("n").cast("decimal(19,0)")
    sums = values.groupBy("comparison").agg(F.sum("n").alias("filled"), F.sum(n * (n - 1)).alias("equal"))
    possible = F.col("filled").cast("double") * (F.col("filled") - 1)
    return sums.select(
        "comparison", "filled", (F.col("equal") / 2).cast("decimal(38,0)").alias("equal_pairs"),
        F.when(possible > 0, F.col("equal").cast("double") / possible).otherwise(0.0).alias("u"))


def train_u(df: DataFrame, comparisons: list[Comparison], rows: int, max_pairs: int = RANDOM_PAIRS,
            key: str = "unique_id", paired_records: int = PAIRED_RECORDS) \
        -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """u per level and its standard error: of equality from all values, and so exact; of the weaker
    levels, where a comparison has any, what random pairs that are not equal say of the rest."""
    equal = {r["comparison"]: r["u"] for r in equality_u(df, comparisons).collect()}  # a row per comparison
    u = {c.column: [0.0] * c.top + [equal.get(c.column, 0.0)] for c in comparisons}
    error = {c.column: [0.0] * (c.top + 1) for c in comparisons}
    for c in comparisons:
        u[c.column][0] = 1 - u[c.column][-1]
    fuzzy = [c for c in comparisons if c.top > 1]
    if fuzzy:
        found = estimate_u(df, fuzzy, rows, max_pairs, key, paired_records).collect()  # a row per level
        for c in fuzzy:
            pairs = {r["level"]: r["pairs"] for r in found if r["comparison"] == c.column}
            unequal = sum(pairs[level] for level in range(c.top))
            rest = 1 - u[c.column][-1]
            for level in range(c.top):
                # one pair more on each level stands for what so many pairs cannot rule out
                share = (pairs[level] + 1) / (unequal + c.top)
                u[c.column][level] = rest * share
                error[c.column][level] = rest * math.sqrt(share * (1 - share) / (unequal + c.top))
    return {c: [max(x, _FLOOR) for x in levels] for c, levels in u.items()}, error


# ---------------------------------------------------------------- m, by EM


@dataclass(frozen=True)
class SampledRule(BlockingRule):
    """The rule on part of its pairs: every block falls into ``pieces`` by a hash of the record,
    and a ``share`` of the pieces is kept by a hash of block and piece. Each pair of the rule
    is kept with the same probability, ``share / pieces``."""

    share: float = 1.0
    pieces: int = 1
    record: str = "unique_id"

    def reads(self) -> tuple[str, ...]:
        return (*self.columns, self.record)

    def key(self) -> Column:
        whole = super().key()
        if self.share >= 1 and self.pieces == 1:
            return whole
        piece = F.pmod(F.xxhash64(F.col(self.record)), F.lit(self.pieces).cast("bigint"))
        own = F.concat_ws("#", piece, F.nullif(whole, F.lit("")))
        return F.when(whole.isNotNull() & (hash_share(own) < self.share), own)


def training_rules(costs: list[RuleCost], comparisons: list[Comparison],
                   least: int = RULES_PER_COMPARISON) -> list[RuleCost]:
    """The rules to train on, in their order: those with the fewest pairs, as the share of matches is
    largest there, until ``least`` of them leave each comparison open that any rule does. A
    comparison is open under a rule that holds no column of the same source, as what holds a name
    also holds its sound."""
    paired = sorted((c for c in costs if c.comparisons > 0), key=lambda c: (c.comparisons, c.rule.name))
    open_ = {c.rule: {x.column for x in comparisons if not _held(x, c.rule)} for c in paired}
    missing = {x.column: min(least, sum(x.column in some for some in open_.values())) for x in comparisons}
    chosen = set()
    for cost in paired:
        if any(missing[column] > 0 for column in open_[cost.rule]):
            chosen.add(cost.rule)
            for column in open_[cost.rule]:
                missing[column] -= 1
    return [c for c in costs if c.rule in chosen]


def beyond_chance(df: DataFrame, costs: list[RuleCost], rows: int) -> list[RuleCost]:
    """The rules that bring over twice the pairs that chance agreement on each of their columns, taken as
    independent, would. One job over the columns of rules with several; rules of one column stay."""
    columns = sorted({c for cost in costs if len(cost.rule.columns) > 1 for c in cost.rule.columns})
    if not columns:
        return costs
    u = {r["comparison"]: r["u"] for r in _equality(df, columns).collect()}  # a row per column
    possible = rows * (rows - 1) / 2
    return [c for c in costs if len(c.rule.columns) < 2
            or c.comparisons > 2 * possible * math.prod(u.get(x, 0.0) for x in c.rule.columns)]


def _held(comparison: Comparison, rule: BlockingRule) -> bool:
    return column_source(comparison.column) in {column_source(c) for c in rule.columns}


def training_blocks(df: DataFrame, rules: list[BlockingRule], training_pairs: int,
                    key: str = "unique_id", costs: list[RuleCost] | None = None) -> tuple[DataFrame, list[SampledRule]]:
    """The rules, each on so many blocks of the whole table that about ``training_pairs`` pairs
    are expected, and the records in those. Blocks are taken whole where they are small next to
    that number, so that matches survive however small the share; else in pieces, so that a
    few large blocks are not all or nothing."""
    some = []
    for cost in costs or cost_rules(df, rules):
        wanted = min(training_pairs / max(cost.comparisons, 1), 1.0)
        piece_rows = max(math.sqrt(2 * training_pairs / _LEAST_PIECES), 2)
        pieces = max(min(math.ceil(cost.largest_block / piece_rows), math.floor(1 / wanted)), 1)
        some.append(SampledRule(cost.rule.name, cost.rule.columns, wanted * pieces, pieces, key))
    if all(rule.share >= 1 and rule.pieces == 1 for rule in some):
        return df, some
    used = reduce(lambda a, b: a | b, [rule.key().isNotNull() for rule in some])
    return materialize(df.where(used), "training"), some  # read several times, and a part only


def training_patterns(df: DataFrame, rules: list[BlockingRule], comparisons: list[Comparison],
                      key: str = "unique_id") -> DataFrame:
    """(rule_no, gamma columns, pairs): the pairs of every rule, counted per pattern.

    Identical records are compared once and counted by their number; their pairs among
    themselves are known to agree throughout and are counted without being formed.
    """
    columns = [c.column for c in comparisons]
    used = sorted({*columns, *rule_columns(rules)} - {key})
    copies = find_copies(df, used, key).where(F.col(key) == F.col("rep_id"))
    distinct = materialize(df.select(key, *used).join(copies.select(key, "copies"), key), "distinct")  # read four times
    gammas = [c.gamma for c in comparisons]
    costs = cost_rules(distinct, rules)
    largest, total = max(c.largest_block for c in costs), sum(c.comparisons for c in costs)
    if comparable(distinct, comparisons):  # counted where they are compared, so no pair leaves its task
        between = compared_pairs(distinct, rules, comparisons, (), key, largest, total, every_rule=True, counted="copies")
    else:
        pairs = block_pairs(distinct, rules, [*columns, "copies"], key, largest, total, every_rule=True)
        between = compare_pairs(pairs, comparisons).select(
            "rule_no", *gammas, (F.col("copies_l") * F.col("copies_r")).alias("pairs"))
    among = F.floor(F.col("copies") * (F.col("copies") - 1) / 2)
    parts = [getattr(rule, "pieces", 1) for rule in rules]
    if max(parts) > 1:  # copies go where the one that stands for them goes: count as many as others
        among = among / F.get(F.array(*map(F.lit, parts)), F.col("rule_no"))
    repeated = self_levels(keyed(distinct.where("copies > 1"), rules), comparisons).select(
        "rule_no", *gammas, among.alias("pairs"))
    return between.unionByName(repeated).groupBy("rule_no", *gammas).agg(
        F.sum("pairs").alias("pairs"))


def _lookup(table: list[list[float]], place: str) -> str:
    """table[rule_no][place] as SQL. Spark folds the table into one constant outside the
    generated code, so a round is compiled once and reused with other numbers."""
    rows = ", ".join(f"array({', '.join(f'{float(x)!r}D' for x in row)})" for row in table)
    return f"get(get(array({rows}), rule_no), {place})"


def start_m(top: int) -> list[float]:
    return [(1 - _TOP_START) / top] * top + [_TOP_START]


@dataclass
class Training:
    """What each rule's run ended with; a rule without pairs has an empty m."""

    m: list[dict[str, list[float]]]
    prior: list[float]
    objective: list[list[float]]
    pairs: list[int]
    converged: list[bool]


def _em_start(comparisons: list[Comparison], rules: list[BlockingRule], u: dict[str, list[float]],
              prior: float) -> tuple[list[dict[str, list[float]]], list[float]]:
    """m of the comparisons that each rule leaves open, and the share of matches among its pairs."""
    m = [{c.column: start_m(c.top) for c in comparisons if c.column not in rule.columns} for rule in rules]
    priors = []
    for rule in rules:
        odds = prior / max(1 - prior, _FLOOR)
        for c in comparisons:
            if c.column in rule.columns:
                odds *= _TOP_START / max(u[c.column][-1], _FLOOR)
        priors.append(min(max(odds / (1 + odds), _FLOOR), 1 - 1e-3))
    return m, priors


def _ratios(m: list[float], u: list[float]) -> list[float]:
    """ln(m / u) per level, with 0 in front for a missing side."""
    return [0.0, *(math.log(max(x, _FLOOR) / max(y, _FLOOR)) for x, y in zip(m, u))]


def em_rounds(levels: np.ndarray, pairs: np.ndarray, comparisons: list[Comparison], m: dict[str, list[float]],
              u: dict[str, list[float]], prior: float, convergence: float = CONVERGENCE,
              max_rounds: int = MAX_ROUNDS) -> tuple[dict[str, list[float]], float, list[float], bool]:
    """EM on patterns at hand: ``levels`` has a row per pattern and a column per comparison, ``pairs``
    its number of pairs. Comparisons that ``m`` lacks are not looked at. What comes back: m, the share
    of matches, the objective of each round, and whether it settled."""
    m, objective, settled = dict(m), [], False
    for _ in range(max_rounds):
        odds = np.full(len(pairs), math.log(prior / (1 - prior)))
        for i, c in enumerate(comparisons):
            if c.column in m:
                odds += np.array(_ratios(m[c.column], u[c.column]))[levels[:, i] + 1]
        p = 1 / (1 + np.exp(-odds))
        objective.append(float((pairs * (math.log(1 - prior) + np.logaddexp(0, odds))).sum()))
        prior = min(max(float((pairs * p).sum() / pairs.sum()), _FLOOR), 1 - _FLOOR)
        moved = 0.0
        for i, c in enumerate(comparisons):
            if c.column in m:
                found = np.bincount(levels[:, i] + 1, weights=pairs * p, minlength=c.top + 2)[1:]
                if found.sum() > 0:
                    fresh = (found / found.sum()).tolist()
                    moved = max(moved, *(abs(a - b) for a, b in zip(fresh, m[c.column])))
                    m[c.column] = fresh
        if moved < convergence:
            settled = True
            break
    return m, prior, objective, settled


def expectation_maximisation(patterns: DataFrame, comparisons: list[Comparison],
                             rules: list[BlockingRule], u: dict[str, list[float]], prior: float,
                             convergence: float = CONVERGENCE, max_rounds: int = MAX_ROUNDS,
                             most_patterns: int = MOST_PATTERNS) -> Training:
    """m for every rule's pairs; u stays as estimated.

    The pairs were reduced to pattern counts before. Up to ``most_patterns`` of them are brought to
    the driver, where a round is a few array operations; with more, a round is one aggregation for
    all rules that returns one row per rule. A comparison on a column of the rule is left out
    of that rule's run, since all its pairs agree there.
    """
    patterns = patterns.persist()
    try:
        if patterns.count() > most_patterns:
            return _em_by_jobs(patterns, comparisons, rules, u, prior, convergence, max_rounds)
        table = patterns.select("rule_no", "pairs", *[c.gamma for c in comparisons]).toPandas()
    finally:
        patterns.unpersist()
    starts, priors = _em_start(comparisons, rules, u, prior)
    found = Training([], [], [], [], [])
    for no in range(len(rules)):
        own = table[table["rule_no"] == no]
        pairs = own["pairs"].to_numpy(dtype=float)
        levels = own[[c.gamma for c in comparisons]].to_numpy(dtype=np.int64)
        m, share, objective, settled = ({}, priors[no], [], False) if not len(own) else em_rounds(
            levels, pairs, comparisons, starts[no], u, priors[no], convergence, max_rounds)
        for values, value in zip((found.m, found.prior, found.objective, found.pairs, found.converged),
                                 (m, share, objective, int(pairs.sum()), settled)):
            values.append(value)
    return found


def _em_by_jobs(patterns: DataFrame, comparisons: list[Comparison], rules: list[BlockingRule],
                u: dict[str, list[float]], prior: float, convergence: float, max_rounds: int) -> Training:
    m, priors = _em_start(comparisons, rules, u, prior)
    objective: list[list[float]] = [[] for _ in rules]
    running = set(range(len(rules)))
    sums = ", ".join(
        f"sum(CASE WHEN `{c.gamma}` = {level} THEN pairs * p ELSE 0.0D END) AS `{i}:{level}`"
        for i, c in enumerate(comparisons) for level in range(c.top + 1))
    for _ in range(max_rounds):
        terms = [_lookup([[math.log(p / (1 - p))] for p in priors], "0")]
        for c in comparisons:
            ratios = [_ratios(run[c.column], u[c.column]) if c.column in run else [0.0] * (c.top + 2) for run in m]
            terms.append(_lookup(ratios, f"`{c.gamma}` + 1"))
        rest = _lookup([[math.log(1 - p)] for p in priors], "0")
        # one aggregated row per rule comes back
        rows = patterns.sparkSession.sql(f"""
            SELECT rule_no, sum(pairs) AS pairs, sum(pairs * p) AS matches,
                   sum(pairs * (rest + ln(1.0D + exp(odds)))) AS objective, {sums}
            FROM (SELECT *, 1.0D / (1.0D + exp(-odds)) AS p
                  FROM (SELECT *, {" + ".join(terms)} AS odds, {rest} AS rest FROM {{patterns}}))
            GROUP BY rule_no
        """, patterns=patterns).collect()
        moved = dict.fromkeys(range(len(rules)), 0.0)
        for row in rows:
            no = row["rule_no"]
            if no not in running:
                continue
            objective[no].append(row["objective"])
            priors[no] = min(max(row["matches"] / row["pairs"], _FLOOR), 1 - _FLOOR)
            for i, c in enumerate(comparisons):
                if c.column not in m[no]:
                    continue
                found = [row[f"{i}:{level}"] for level in range(c.top + 1)]
                total = sum(found)
                if total > 0:
                    fresh = [x / total for x in found]
                    change = max(abs(a - b) for a, b in zip(fresh, m[no][c.column]))
                    moved[no] = max(moved[no], change)
                    m[no][c.column] = fresh
        running = {no for no in running if moved[no] >= convergence}
        if not running:
            break
    seen = {row["rule_no"]: int(row["pairs"]) for row in rows}
    return Training(
        [run if i in seen else {} for i, run in enumerate(m)], priors, objective,
        [seen.get(i, 0) for i in range(len(rules))],
        [i in seen and i not in running for i in range(len(rules))])


def mixture_levels(df: DataFrame, rule: SampledRule, patterns: DataFrame, rule_no: int,
                   comparisons: list[Comparison], rows: int, max_pairs: int, key: str = "unique_id",
                   paired_records: int = PAIRED_RECORDS) -> DataFrame:
    """(gamma columns, pairs): a weighted sample of all pairs of records. The pairs of one rule are there
    by their number, the others by random pairs, each standing for as many as were not drawn."""
    gammas = [c.gamma for c in comparisons]
    share = rule.share / rule.pieces
    inside = patterns.where(F.col("rule_no") == rule_no).select(*gammas, (F.col("pairs") / share).alias("pairs"))
    held = BlockingRule(rule.name, rule.columns)
    columns = sorted({c.column for c in comparisons})
    drawn = random_pairs(df.withColumn("_held", held.key()), [*columns, "_held"], rows, max_pairs, key, paired_records)
    drawn = drawn.where(~F.coalesce(F.col("_held_l") == F.col("_held_r"), F.lit(False)))
    outside = materialize(
        compare_pairs(drawn, comparisons).groupBy(*gammas).agg(F.count("*").alias("pairs")), "mixture")
    blocked = inside.agg(F.sum("pairs")).first()[0] or 0
    seen = outside.agg(F.sum("pairs")).first()[0] or 1
    weight = max(rows * (rows - 1) / 2 - blocked, 0.0) / seen
    return inside.unionByName(outside.withColumn("pairs", F.col("pairs") * F.lit(weight)))


def _matches_of_rules(runs: Training, rules: list[SampledRule], matches: float) -> list[float]:
    """How many matches each rule brings by its own run. A run that finds over twice as many as there are
    took something else for matches, such as equal names: it counts as one."""
    found = [share * pairs / (rule.share / rule.pieces) for share, pairs, rule in zip(runs.prior, runs.pairs, rules)]
    return [n if n <= 2 * matches else 1.0 for n in found]


def _pooled(levels: list[list[float]], weights: list[float]) -> list[float]:
    """m over the matches of several rules together, a rule weighing as much as it brings matches: one rule's
    matches agree more than others on what goes along with its key. A tenth of a match more on each level
    stands for what so many matches cannot rule out."""
    total = [sum(w * m[i] for w, m in zip(weights, levels)) + 0.1 for i in range(len(levels[0]))]
    return [n / sum(total) for n in total]


def _train_held(df: DataFrame, untrained: list[Comparison], comparisons: list[Comparison], runs: Training,
                some: list[SampledRule], patterns: DataFrame, u: dict[str, list[float]], prior: float, rows: int,
                settings: Settings, max_pairs: int, key: str, paired_records: int) -> dict[str, list[float]]:
    """m of the comparisons that every rule holds, from all pairs rather than from those of a rule, where
    all would agree: the pairs of the rule with the fewest pairs, and random ones for the rest.
    The other comparisons start from what the rules gave. With over ``MOST_PATTERNS`` patterns they
    stay untrained, which the model tells."""
    no = min((i for i, n in enumerate(runs.pairs) if n), key=runs.pairs.__getitem__, default=None)
    if no is None:
        return {}
    mixed = mixture_levels(df, some[no], patterns, no, comparisons, rows, max_pairs, key, paired_records)
    table = mixed.groupBy(*[c.gamma for c in comparisons]).agg(F.sum("pairs").alias("pairs"))
    if table.count() > MOST_PATTERNS:
        return {}
    table = table.toPandas()
    start = {c.column: runs.m[no].get(c.column) or start_m(c.top) for c in comparisons}
    found, _, _, _ = em_rounds(
        table[[c.gamma for c in comparisons]].to_numpy(dtype=np.int64), table["pairs"].to_numpy(dtype=float),
        comparisons, start, u, min(max(prior, _FLOOR), 0.5), settings.convergence, settings.max_rounds)
    return {c.column: found[c.column] for c in untrained}


def train(df: DataFrame, settings: Settings, rows: int, key: str = "unique_id",
          max_pairs: int = RANDOM_PAIRS, training_pairs: int = TRAINING_PAIRS,
          paired_records: int = PAIRED_RECORDS) -> Model:
    """Estimate the prior on all records by capture and recapture, u of equality on all values and
    of weaker levels on about ``max_pairs`` random pairs of ``paired_records`` records, and m on the pairs
    of the rules that ``training_rules`` names: all of them, or those of some blocks where a rule
    brings more than ``training_pairs``. A comparison that all rules hold is trained on a
    weighted sample of all pairs. No bound is in rows, as the pairs left of a sample of rows
    shrink with its square.
    """
    comparisons, rules = settings.comparisons, settings.rules
    costs = cost_rules(df, rules)
    prior = recaptured_prior(df, costs, rows)
    u, u_error = train_u(df, comparisons, rows, max_pairs, key, paired_records)
    used = training_rules(beyond_chance(df, costs, rows), comparisons) or training_rules(costs, comparisons) or costs
    blocks, some = training_blocks(df, [c.rule for c in used], training_pairs, key, used)
    patterns = materialize(training_patterns(blocks, some, comparisons, key), "patterns")
    runs = expectation_maximisation(
        patterns, comparisons, some, u, prior, settings.convergence, settings.max_rounds)
    m, missing = {}, []
    weights = _matches_of_rules(runs, some, prior * rows * (rows - 1) / 2)
    for c in comparisons:
        open_ = [i for i, rule in enumerate(some) if c.column in runs.m[i] and not _held(c, rule)]
        open_ = open_ or [i for i in range(len(some)) if c.column in runs.m[i]]
        if open_:
            m[c.column] = _pooled([runs.m[i][c.column] for i in open_], [weights[i] for i in open_])
        else:
            missing.append(c)
    if missing:
        m |= _train_held(df, missing, comparisons, runs, some, patterns, u, prior, rows, settings, max_pairs,
                         key, paired_records)
    if blocks is not df:
        forget(blocks)
    forget(patterns)
    trained = [c.column for c in comparisons if c.column in m]
    untrained = [c.column for c in comparisons if c.column not in m]
    m |= {c.column: start_m(c.top) for c in comparisons if c.column in untrained}
    told = [{"rule": rule.name, "share": rule.share / rule.pieces, "pairs": runs.pairs[i],
             "rounds": len(runs.objective[i]), "converged": runs.converged[i]}
            for i, rule in enumerate(some)]
    return Model(prior, comparisons, {c.column: m[c.column] for c in comparisons}, u, rules, trained, untrained, u_error, told)


# ---------------------------------------------------------------- scores


def match_weight(model: Model, tf_left: str = "_l", tf_right: str = "_r") -> Column:
    """log2 odds of a match from the gamma columns; on equality of a value with term
    frequencies, its own frequency takes the place of the average u."""
    terms = [F.lit(model.prior_weight)]
    for c in model.comparisons:
        table = F.array(*[F.lit(w) for w in model.weights(c)])
        terms.append(F.get(table, F.col(c.gamma) + 1))
        if c.term_frequency:
            common = F.greatest(f"tf_{c.column}{tf_left}", f"tf_{c.column}{tf_right}")
            usual = max(model.u[c.column][-1], _FLOOR)
            terms.append(F.when(F.col(c.gamma) == c.top, F.log2(F.lit(usual) / common))
                         .otherwise(0.0))
    return reduce(lambda a, b: a + b, terms)


def with_score(compared: DataFrame, model: Model, keep_levels: bool = False,
               tf_left: str = "_l", tf_right: str = "_r") -> DataFrame:
    """Add match_weight and match_probability; drop what they were made from unless
    ``keep_levels``."""
    scored = compared.withColumn("match_weight", match_weight(model, tf_left, tf_right))
    scored = scored.withColumn(
        "match_probability", F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.0), -F.col("match_weight"))))
    if keep_levels:
        return scored
    used = {c.gamma for c in model.comparisons}
    used |= {f"{c}{end}" for c in compared_columns(model.comparisons)
             for end in {tf_left, tf_right}}
    return scored.drop(*[c for c in scored.columns if c in used])


def highest_weight(model: Model, tf_left: str = "_l", tf_right: str = "_r", rough: tuple[str, ...] = DEAR_KINDS) -> Column:
    """No less than the ``match_weight`` of a pair, without the comparisons of the ``rough`` kinds: those
    count by the best level that equal, unequal and missing values leave, and unequal users of an email."""
    terms = [F.lit(model.prior_weight + 1e-6)]  # sums in another order differ in the last digits
    for c in model.comparisons:
        left, right = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
        weights = model.weights(c)
        rarest = F.lit(0.0)
        if c.term_frequency:
            common = F.greatest(f"tf_{c.column}{tf_left}", f"tf_{c.column}{tf_right}")
            rarest = F.log2(F.lit(max(model.u[c.column][-1], _FLOOR)) / common)
        if c.kind in rough:
            below = F.lit(max(weights[1:-1]))
            if c.kind == "email":
                below = F.when(email_user(left) == email_user(right), below).otherwise(max(weights[1:-2]))
            best = F.when(left.isNull() | right.isNull(), weights[0]).when(left == right, rarest + weights[-1]).otherwise(below)
        else:
            best = F.get(F.array(*[F.lit(w) for w in weights]), gamma(c, left, right) + 1)
            if c.term_frequency:
                best = best + F.when(left == right, rarest).otherwise(0.0)
        terms.append(best)
    return reduce(lambda a, b: a + b, terms)


def worth_comparing(pairs: DataFrame, model: Model, least: float, tf_left: str = "_l", tf_right: str = "_r") -> DataFrame:
    """The pairs that can come to the probability ``least``, by ``highest_weight``; where a term frequency
    is missing that cannot be told, and the pair stays. What costs most in Spark is looked at last, for pairs
    that the rest leaves in."""
    if not 0 < least < 1:
        return pairs
    steps = [DEAR_KINDS]
    if any(c.kind in LATER_KINDS for c in model.comparisons):
        steps.insert(0, (*DEAR_KINDS, *LATER_KINDS))
    for rough in steps:
        highest = highest_weight(model, tf_left, tf_right, rough)
        pairs = pairs.where(F.coalesce(highest >= math.log2(least / (1 - least)), F.lit(True)))
    return pairs


def lower_bound(model: Model, least: float | None, tf: tuple[str, ...] = ("l", "r")) -> Bound | None:
    """What ``worth_comparing`` goes by, for pairs that are compared in cells."""
    if least is None or not 0 < least < 1:
        return None
    return Bound(
        math.log2(least / (1 - least)), model.prior_weight, {c.column: model.weights(c) for c in model.comparisons},
        {c.column: max(model.u[c.column][-1], _FLOOR) for c in model.comparisons}, tf)


def _scored(pairs: DataFrame, model: Model, threshold: float | None, keep_levels: bool) -> DataFrame:
    """``pairs`` compared and scored; with a threshold those that reach it, and only what can is compared in full."""
    if threshold is None:
        return with_score(compare_pairs(pairs, model.comparisons), model, keep_levels)
    compared = compare_pairs(worth_comparing(pairs, model, threshold), model.comparisons)
    return with_score(compared, model, keep_levels).where(F.col("match_probability") >= threshold)


def predict(df: DataFrame, model: Model, threshold: float | None = None, key: str = "unique_id",
            largest_block: int | None = None, pairs: int | None = None,
            carry: list[str] = (), keep_levels: bool = False, block_rows: int | None = None,
            refinement: Refinement | None = None, keep_values: bool = True) -> DataFrame:
    """Scored candidate pairs of ``df`` (which has the ``tf_`` columns). What the rules cost
    is looked up when not given, so that large blocks are always cut into pieces. With ``block_rows``
    blocks of more records are refined instead of compared throughout. ``keep_levels`` keeps what the scores
    were made from; without ``keep_values`` the compared values may be missing from it."""
    if block_rows is not None and comparable(df, model.comparisons):
        columns = compared_columns(model.comparisons)
        columns = columns if keep_levels and keep_values else [c for c in columns if c.startswith("tf_")]
        compared = compared_refined(
            df, model.rules, model.comparisons, [*columns, *carry], key, block_rows, None, refinement, lower_bound(model, threshold))
        scored = with_score(compared, model, keep_levels)
        return scored if threshold is None else scored.where(F.col("match_probability") >= threshold)
    if block_rows is not None:
        met = refined_pairs(df, model.rules, [*compared_columns(model.comparisons), *carry], key, block_rows,
                            refinement=refinement)
        return _scored(met, model, threshold, keep_levels)
    if pairs is None or largest_block is None:
        costs = cost_rules(df, model.rules)
        largest_block = max(c.largest_block for c in costs)
        pairs = sum(c.comparisons for c in costs)
    columns = [*compared_columns(model.comparisons), *carry]
    if not comparable(df, model.comparisons):
        return _scored(block_pairs(df, model.rules, columns, key, largest_block, pairs), model, threshold, keep_levels)
    if not (keep_levels and keep_values):
        columns = [*(c for c in columns if c.startswith("tf_")), *carry]
    compared = compared_pairs(
        df, model.rules, model.comparisons, columns, key, largest_block, pairs, bound=lower_bound(model, threshold))
    scored = with_score(compared, model, keep_levels)
    return scored if threshold is None else scored.where(F.col("match_probability") >= threshold)


def self_scores(df: DataFrame, model: Model) -> DataFrame:
    """match_probability of each record with an identical copy of itself."""
    return with_score(self_levels(df, model.comparisons), model, True, "", "")

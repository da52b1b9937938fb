"""Blocking: which records are worth comparing, and what that costs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize
from .skew import in_small_tasks, skew_join

# The limit of rule proposal, and those of selection that a caller may ask for.
RULE_ABOVE = 0.3
MAX_COMPARISONS = 20_000_000
PAIRS_PER_RECORD = 500

# A block with more pairs than this is compared in cells of about this many.
PIECE_PAIRS = 4_000_000
# ... nor in more cells than would be this many for all pairs: more do not level the tasks, and every
# cell of a block copies its rows, which so are copied about this number's square root of times at most.
MOST_CELLS = 4_096
# Base and incoming records of a block meet in cells of at most about this many of each.
PIECE_ROWS = 2_000
# Comparing is heavy next to reading, so tasks are cut by pairs rather than by bytes.
TASK_PAIRS = 100_000
# With more combinations of rules than this, the pairs of any rule are formed to be counted.
MOST_COMBINATIONS = 255
MAX_TASKS = 20_000


@dataclass(frozen=True)
class BlockingRule:
    """Two records are compared when all ``columns`` are equal and filled."""

    name: str
    columns: tuple[str, ...]

    def reads(self) -> tuple[str, ...]:
        """The columns that ``key`` is made of."""
        return self.columns

    def key(self) -> Column:
        """The block of a record as one text, null when a column is null or blank. Doubled
        bars before the separator keep ("a|", "b") apart from ("a", "|b")."""
        parts = []
        for column in self.columns:
            filled = F.nullif(F.col(column).cast("string"), F.lit(""))
            parts += [F.replace(filled, F.lit("|"), F.lit("||")), F.lit("|,")]
        return F.concat(*parts[:-1])


@dataclass(frozen=True)
class RuleCost:
    rule: BlockingRule
    comparisons: int
    largest_block: int
    blocks: int


@dataclass
class Diagnosis:
    rule: BlockingRule
    comparisons: int
    kept: bool
    reason: str


def rule_columns(rules: Iterable[BlockingRule]) -> list[str]:
    """Columns the rules use, sorted."""
    return sorted({c for rule in rules for c in rule.columns})


# The rules that can be proposed, in this order.
BASIC_RULES = (
    ("exact_email", ("email_norm",)),
    ("exact_phone", ("phone_digits",)),
    ("exact_first_last_name", ("first_name_norm", "last_name_norm")),
    ("metaphone_full_name", ("first_name_metaphone", "last_name_metaphone")),
    ("zip_lastname_meta", ("zip_norm", "last_name_metaphone")),
    ("city_firstname", ("city_norm", "first_name_norm")),
)
WIDE_RULES = (
    ("exact_email", ("email_norm",)),
    ("exact_phone", ("phone_digits",)),
    ("exact_zip", ("zip_norm",)),
    ("exact_date", ("date_norm",)),
    ("exact_first_last_name", ("first_name_norm", "last_name_norm")),
    ("metaphone_full_name", ("first_name_metaphone", "last_name_metaphone")),
    ("exact_last_name_metaphone", ("last_name_metaphone",)),
    ("zip_lastname_meta", ("zip_norm", "last_name_metaphone")),
    ("city_firstname", ("city_norm", "first_name_norm")),
    ("first_name_first_char", ("first_name_first_char",)),
    *((f"near_{i}", (f"geo_cell_{i}",)) for i in range(4)),
)


def propose_rules(columns: Iterable[str], roles: dict, shares: dict[str, float],
                  rules: str = "wide") -> list[BlockingRule]:
    """Candidate rules whose columns exist and, but for the basic rules, are filled in
    more than ``RULE_ABOVE`` of the rows."""
    have = set(columns)
    if rules == "basic":
        return [BlockingRule(n, c) for n, c in BASIC_RULES if have.issuperset(c)]
    wanted = []
    number = roles.get("numeric_id")
    if number:
        wanted += [(f"exact_{number}", (number,)), (f"{number}_mod_1000", (f"{number}_mod_1000",))]
        if rules == "wide":
            wanted.append((f"hash_{number}", (f"{number}_hash",)))
    wanted += WIDE_RULES
    if "category_enum" in roles:
        wanted.append((f"exact_{roles['category_enum']}", (roles["category_enum"],)))
    if "text_freeform" in roles:
        text = roles["text_freeform"]
        wanted.append((f"hash_{text}", (f"{text}_hash",)))
    if "url" in roles and rules == "wide":
        wanted.append(("url_domain_exact", ("url_domain",)))
    return [
        BlockingRule(name, tuple(cols)) for name, cols in wanted
        if have.issuperset(cols) and all(shares.get(c, 0.0) > RULE_ABOVE for c in cols)
    ]


def keyed(df: DataFrame, rules: list[BlockingRule]) -> DataFrame:
    """One row per record and rule it takes part in: adds rule_no and block_key, and
    ``_keys``, the keys under all rules."""
    return (
        df.withColumn("_keys", F.array(*[r.key() for r in rules]))
        .select("*", F.posexplode("_keys").alias("rule_no", "block_key"))
        .where("block_key IS NOT NULL")
    )


def block_sizes(df: DataFrame, rules: list[BlockingRule]) -> DataFrame:
    """(rule_no, block_key, block_rows); counted on the map side first."""
    rows = in_small_tasks(df.select(*sorted({c for rule in rules for c in rule.reads()})), len(rules))
    return (keyed(rows, rules)
            .groupBy("rule_no", "block_key").agg(F.count("*").alias("block_rows")))


def pair_total(rows: Column) -> Column:
    """Pairs in groups of ``rows`` rows, wide enough for blocks of any size."""
    wide = rows.cast("decimal(19,0)")
    return F.floor(F.coalesce(F.sum(wide * (wide - 1)), F.lit(0)) / 2)


def cost_rules(df: DataFrame, rules: list[BlockingRule]) -> list[RuleCost]:
    """Exact number of pairs of every rule from its block sizes: one job, no join."""
    rows = (
        block_sizes(df, rules).groupBy("rule_no")
        .agg(pair_total(F.col("block_rows")).alias("pairs"),
             F.max("block_rows").alias("largest"), F.count("*").alias("blocks"))
        .collect()  # one row per rule
    )
    found = {r["rule_no"]: r for r in rows}
    return [
        RuleCost(rule, int(r["pairs"]), r["largest"], r["blocks"]) if r else RuleCost(rule, 0, 0, 0)
        for rule, r in ((rule, found.get(i)) for i, rule in enumerate(rules))
    ]


def comparison_limit(rows: int) -> int:
    """A limit to name as ``max_comparisons``, nowhere a default: a number of pairs per record,
    so that a rule's fate does not hang on the size of the table, at least ``MAX_COMPARISONS``."""
    return max(MAX_COMPARISONS, PAIRS_PER_RECORD * rows)


def select_rules(costs: list[RuleCost], max_rules: int | None = None,
                 max_comparisons: int | None = None) \
        -> tuple[list[BlockingRule], list[Diagnosis]]:
    """All rules that have pairs, cheapest first; with limits, the cheapest within them. When
    none qualifies, the one with the fewest pairs, or the first when no rule yields a pair."""
    notes = []
    for cost in costs:
        reason = ("zero_comparisons" if cost.comparisons == 0 else
                  "too_many_comparisons" if max_comparisons is not None and cost.comparisons > max_comparisons
                  else "selected")
        notes.append(Diagnosis(cost.rule, cost.comparisons, reason == "selected", reason))
    chosen = sorted((n for n in notes if n.kept), key=lambda n: n.comparisons)[:max_rules]
    if not chosen and notes:
        paired = [n for n in notes if n.comparisons > 0]
        last = min(paired, key=lambda n: n.comparisons) if paired else notes[0]
        last.kept = True
        last.reason = "fallback_min_comparisons" if paired else "fallback_first_candidate"
        chosen = [last]
    return [n.rule for n in chosen], notes


def diagnostics_table(spark: SparkSession, notes: list[Diagnosis]) -> DataFrame:
    rows = [(n.rule.name, Decimal(n.comparisons), n.kept, n.reason, sorted(n.rule.columns)) for n in notes]
    return spark.createDataFrame(
        rows, "name string, comparisons decimal(38,0), kept boolean, reason string, "
              "columns array<string>")


def _in_cells(side: DataFrame, large: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
    """Lay the pairs of large blocks out as a grid: a row stands in one stripe of its own side
    and is copied along the stripes of the other, so every pair meets in exactly one cell and a
    block of n rows makes n times the square root of its cells, not n times its cells."""
    side = skew_join(side, large, ["rule_no", "block_key"], "block_rows", "left")
    stripe = F.pmod(F.xxhash64(id_column), F.coalesce(f"_stripes_{own}", F.lit(1).cast("bigint")))
    along = F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"_stripes_{other}", F.lit(1).cast("bigint")) - 1)
    return side.withColumn(f"_cell_{own}", stripe).withColumn(f"_cell_{other}", F.explode(along)).drop(
        "_stripes_l", "_stripes_r", "block_rows")


def _large_blocks(sizes: DataFrame, side: int) -> DataFrame:
    """The blocks of ``sizes`` (rows_l, rows_r) with more than ``side`` rows on a side that meet
    any, and their stripes; written, as both sides of a join read it."""
    large = sizes.where((F.greatest("rows_l", "rows_r") > side) & (F.least("rows_l", "rows_r") > 0))
    stripes = [F.ceil(F.col(f"rows_{end}") / side).alias(f"_stripes_{end}") for end in "lr"]
    rows = F.greatest("rows_l", "rows_r").alias("block_rows")
    return materialize(large.select("rule_no", "block_key", rows, *stripes), "large-blocks")


def _first_rule_only(rules: list[BlockingRule], left: str, right: str) -> Column:
    """False for a pair that an earlier rule brings too."""
    earlier = [
        (F.col("rule_no") > i) & F.coalesce(F.get(left, F.lit(i)) == F.get(right, F.lit(i)),
                                            F.lit(False))
        for i in range(len(rules) - 1)
    ]
    return ~reduce(lambda a, b: a | b, earlier) if earlier else F.lit(True)


def _side(df: DataFrame, rules: list[BlockingRule], columns: list[str], end: str, count: int | None = None) -> DataFrame:
    needed = list(dict.fromkeys([*columns, *rule_columns(rules)]))
    rows = keyed(in_small_tasks(df.select(*needed), len(rules), count), rules)
    renamed = [F.col(c).alias(f"{c}_{end}") for c in columns]
    return rows.select("rule_no", "block_key", F.col("_keys").alias(f"_keys_{end}"), *renamed)


def tasks_for(pairs: int | None) -> int | None:
    """Number of tasks for that many pairs."""
    return None if pairs is None else min(max(pairs // TASK_PAIRS, 1), MAX_TASKS)


def block_pairs(df: DataFrame, rules: list[BlockingRule], columns: list[str] = (),
                key: str = "unique_id", largest_block: int | None = None,
                pairs: int | None = None, every_rule: bool = False,
                piece_pairs: int = PIECE_PAIRS) -> DataFrame:
    """Pairs of records that share a block, ``<key>_l < <key>_r``, each pair once, under
    the first rule that brings it (``rule_no``); with ``every_rule``, once per rule.

    The compared ``columns`` travel with the records, so comparing needs no further
    shuffle, and repeated pairs are recognised from the keys rather than by a distinct.
    All rules share a single exchange. From ``cost_rules``, asked when they are not given:
    ``largest_block`` decides whether large blocks must meet cell by cell, ``pairs`` the
    number of tasks.
    """
    if largest_block is None or pairs is None:
        costs = cost_rules(df, rules)
        largest_block = max(c.largest_block for c in costs) if largest_block is None else largest_block
        pairs = sum(c.comparisons for c in costs) if pairs is None else pairs
    carried = list(dict.fromkeys([key, *columns]))
    count = df.count()
    left, right = _side(df, rules, carried, "l", count), _side(df, rules, carried, "r", count)
    on = ["rule_no", "block_key"]
    if largest_block**2 > piece_pairs:
        piece_pairs = max(piece_pairs, 2 * pairs // MOST_CELLS)  # a cell of n by n rows, of which half the pairs are in order
        sizes = block_sizes(df, rules).select(
            "rule_no", "block_key", F.col("block_rows").alias("rows_l"), F.col("block_rows").alias("rows_r"))
        large = _large_blocks(sizes, max(isqrt(piece_pairs), 1))
        left = _in_cells(left, large, f"{key}_l", "l", "r")
        right = _in_cells(right, large, f"{key}_r", "r", "l")
        on += ["_cell_l", "_cell_r"]
    tasks = tasks_for(pairs)
    left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    met = left.join(right, on).where(F.col(f"{key}_l") < F.col(f"{key}_r"))
    if not every_rule:
        met = met.where(_first_rule_only(rules, "_keys_l", "_keys_r"))
    return met.drop("_keys_l", "_keys_r", "block_key", "_cell_l", "_cell_r")


def block_links(new: DataFrame, base: DataFrame, rules: list[BlockingRule],
                columns: list[str], key: str = "unique_id",
                piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pairs of a base record (``_l``) and an incoming record (``_r``) sharing a block.
    Blocks with over ``piece_rows`` records on either side meet in cells of that many by
    that many, so neither many base records nor many arrivals of one key make a long task, and
    tasks are cut by pairs."""
    carried = list(dict.fromkeys([key, *columns]))
    left, right = _side(base, rules, carried, "l"), _side(new, rules, carried, "r")
    on = ["rule_no", "block_key"]
    sizes = block_sizes(base, rules).withColumnRenamed("block_rows", "rows_l").join(
        block_sizes(new, rules).withColumnRenamed("block_rows", "rows_r"), on)
    large = _large_blocks(sizes, piece_rows)
    if not large.isEmpty():
        left = _in_cells(left, large, f"{key}_l", "l", "r")
        right = _in_cells(right, large, f"{key}_r", "r", "l")
        on += ["_cell_l", "_cell_r"]
    met = F.col("rows_l").cast("decimal(19,0)") * F.col("rows_r")
    tasks = tasks_for(int(sizes.agg(F.sum(met)).first()[0] or 0))
    left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    return (left.join(right, on).where(_first_rule_only(rules, "_keys_l", "_keys_r"))
            .drop("_keys_l", "_keys_r", "block_key", "_cell_l", "_cell_r"))


def _union_terms(rules: list[BlockingRule]) -> Counter:
    """Column sets with the number of times the pairs agreeing on them count towards the pairs
    of any rule: inclusion and exclusion, rule by rule, so that equal sets cancel at once."""
    terms: Counter = Counter()
    for rule in rules:
        both = Counter({tuple(rule_columns([rule])): 1})
        for columns, times in terms.items():
            both[tuple(sorted({*columns, *rule.columns}))] -= times
        terms.update(both)
        terms = Counter({c: n for c, n in terms.items() if n})
    return terms


def _formed_pairs(df: DataFrame, rules: list[BlockingRule]) -> int:
    columns = rule_columns(rules)
    alike = df.select(*columns).groupBy(*columns).agg(F.count("*").alias("_copies"))
    alike = materialize(alike.withColumn("_row", F.monotonically_increasing_id()), "alike")
    between = block_pairs(alike, rules, ["_copies"], "_row").select(
        (F.col("_copies_l") * F.col("_copies_r")).alias("n"))
    blocked = reduce(lambda a, b: a | b, [rule.key().isNotNull() for rule in rules])
    among = alike.where(blocked).select(F.floor(F.col("_copies") * (F.col("_copies") - 1) / 2).alias("n"))
    found = between.unionByName(among).agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).first()["n"]
    return int(found or 0)


def matched_pairs(df: DataFrame, rules: list[BlockingRule]) -> int:
    """Number of pairs that at least one rule brings, without forming them: block sizes
    under combinations of rules, added and subtracted in turn. The combinations may double with
    every rule; where they are over ``MOST_COMBINATIONS``, the pairs are formed instead, records
    with equal keys under all rules once and by their number."""
    terms = _union_terms(rules)
    if len(terms) > MOST_COMBINATIONS:
        return _formed_pairs(df, rules)
    combined = [
        F.struct(F.lit(i).alias("combination"), F.lit(times).alias("times"),
                 BlockingRule("", columns).key().alias("block_key"))
        for i, (columns, times) in enumerate(sorted(terms.items()))
    ]
    rows = in_small_tasks(df.select(*rule_columns(rules)), len(combined))
    sizes = (
        rows.select(F.inline(F.array(*combined))).where("block_key IS NOT NULL")
        .groupBy("combination", "times", "block_key").agg(F.count("*").alias("block_rows"))
    )
    totals = sizes.groupBy("times").agg(pair_total(F.col("block_rows")).alias("pairs")).collect()
    return sum(r["times"] * int(r["pairs"]) for r in totals)

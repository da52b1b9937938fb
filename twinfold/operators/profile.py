"""Filtering, sampling and profiling of a record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hash_share

MIN_RECORDS = 2


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without any null (in ``subset``)."""
    return df.dropna(how="any", subset=subset)


def has_records(df: DataFrame, at_least: int = MIN_RECORDS) -> bool:
    return df.limit(at_least).count() >= at_least


def sample_rows(df: DataFrame, key: str, at_most: int, rows: int) -> DataFrame:
    """About ``at_most`` of ``rows`` rows, chosen by a hash of the key: the same rows on
    every run and every layout."""
    if rows <= at_most:
        return df
    return df.where(hash_share(F.col(key)) < at_most / rows)


def unused_columns(df: DataFrame) -> list[str]:
    """Columns of types that have no notion of a single value to profile."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def non_null_counts(df: DataFrame, columns: dict[str, Column]) -> tuple[int, dict[str, int]]:
    """(rows, non-null rows per column) in a single pass."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(n) for n, c in columns.items()])
    values = row.first().asDict()
    return values.pop("_rows"), values


def non_null_shares(df: DataFrame, columns: dict[str, Column] | None = None) -> dict[str, float]:
    """Share of non-null rows per column, 0.0 for an empty table."""
    columns = columns or {c: F.col(c) for c in df.columns}
    rows, counts = non_null_counts(df, columns)
    return {name: (n / rows if rows else 0.0) for name, n in counts.items()}


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as text), one row per cell."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
             for c in columns]
    return df.select(F.inline(F.array(*cells)))


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, non-null rows, distinct values and the two shares, for every column.

    Cells are first reduced per value on the map side, and a value travels as 96 bits of
    hash, so a column of long texts costs no more than one of numbers.
    ``cardinality_ratio`` counts null as a value; ``cardinality_ratio_nonnull`` does not.
    """
    skipped = set(unused_columns(df))
    columns = [c for c in columns or df.columns if c not in skipped]
    value = F.col("value")
    per_value = (
        _long(df, columns)
        .select("column_name", value.isNull().alias("missing"),
                F.xxhash64(value).alias("h1"), F.hash(value).alias("h2"))
        .groupBy("column_name", "missing", "h1", "h2").count()
    )
    present = ~F.col("missing")
    totals = per_value.groupBy("column_name").agg(
        F.sum("count").alias("total_rows"),
        F.coalesce(F.sum(F.when(present, F.col("count"))), F.lit(0)).alias("non_null_rows"),
        F.count_if(present).alias("distinct_values"),
        F.max("missing").alias("has_null"),
    )
    # an empty table still has its columns
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    zero = F.lit(0).cast("bigint")
    counted = F.col("total_rows")
    share = lambda part: F.when(counted > 0, part / counted).otherwise(0.0)
    filled = F.broadcast(names).join(totals, "column_name", "left").select(
        "column_name",
        *[F.coalesce(c, zero).alias(c) for c in ("total_rows", "non_null_rows", "distinct_values")],
        F.coalesce("has_null", F.lit(False)).cast("int").alias("has_null"),
    )
    return filled.select(
        "column_name", "total_rows", "non_null_rows", "distinct_values",
        share(F.col("non_null_rows")).alias("non_null_share"),
        share(F.col("distinct_values") + F.col("has_null")).alias("cardinality_ratio"),
        share(F.col("distinct_values")).alias("cardinality_ratio_nonnull"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return (_long(df, columns).where("value IS NOT NULL")
            .groupBy("column_name", "value").agg(F.count("*").alias("value_count")))


def value_distribution(df: DataFrame, columns: list[str], ends: int = 10) -> DataFrame:
    """The ``ends`` most and least frequent values of every column, with their shares.

    Spark cuts both lists per map task before the shuffle, so a column with any number of
    distinct values sends at most ``ends`` rows per task to the window.
    """
    counts = value_counts(df, columns)
    totals = F.broadcast(counts.groupBy("column_name").agg(
        F.sum("value_count").alias("_total"), F.count("*").alias("distinct_values")))

    def end(name: str, first: Column) -> DataFrame:
        place = Window.partitionBy("column_name").orderBy(first, "value")
        so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= ends)
            .withColumn("_running", F.sum("value_count").over(so_far))
            .join(totals, "column_name")
            .select(
                "column_name", F.lit(name).alias("list"), "place", "value", "value_count",
                "distinct_values", (F.col("value_count") / F.col("_total")).alias("share"),
                (F.col("_running") / F.col("_total")).alias("cumulative_share"),
            )
        )

    return end("top", F.desc("value_count")).unionByName(end("bottom", F.asc("value_count")))


def value_count_percentiles(df: DataFrame, columns: list[str],
                            shares: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """How often the values of a column occur: percentiles of the value counts."""
    found = value_counts(df, columns).groupBy("column_name").agg(
        F.percentile_approx("value_count", list(shares), 100_000).alias("found"))
    wanted = F.array(*[F.lit(s) for s in shares])
    return found.select(
        "column_name", F.inline(F.arrays_zip(wanted.alias("percentile"),
                                             F.col("found").alias("value_count"))))

"""Line dedup by frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.scratch import materialize
from twinfold.operators.skew import skew_join

BOILERPLATE_RATIO = 0.1
LEAST_PAGES = 3
MOST_BROADCAST = 1_000_000  # line hashes (8 bytes each) that may be broadcast; beyond, a shuffled join


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = BOILERPLATE_RATIO,
                least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, n_pages, n_host_pages) of the lines, as 64-bit hashes, that stand on more
    than ``ratio`` of the pages of a host and on ``least_pages`` of them at least. Copies of a
    line on one page count once; blank lines and hosts that are null have none."""
    hosted = pages.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = hosted.groupBy("host").agg(F.count("*").alias("n_host_pages"))
    filled = F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != "")
    hashes = F.array_distinct(F.transform(filled, lambda x: F.xxhash64(x)))
    counted = hosted.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    return counted.join(totals, "host").where(F.col("n_pages") > F.lit(ratio) * F.col("n_host_pages"))


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = BOILERPLATE_RATIO,
                     least_pages: int = LEAST_PAGES) -> DataFrame:
    """The pages without their boilerplate lines, and ``n_lines`` and ``n_dropped``.

    All rows and columns stay; a page may become empty. Null and empty texts, and pages of a
    null host, stay as they are (a null text has 0 lines). Columns named ``n_lines`` and
    ``n_dropped`` are replaced. Lines are compared without blanks at their ends. A host has at
    most (lines of a page / ``ratio``) such lines, which travel as one array per host: by
    broadcast if all of them are few, else by a join in which large hosts are split off.
    """
    found = materialize(boilerplate(pages, host_col, text_col, ratio, least_pages), "boilerplate")
    per_host = materialize(found.groupBy(F.col("host").alias("_tw_host")).agg(
        F.collect_set("line").alias("_tw_lines"), F.max("n_host_pages").alias("_tw_pages")), "per-host")
    pages = pages.drop("n_lines", "n_dropped").withColumn("_tw_host", F.col(host_col))
    if found.count() <= MOST_BROADCAST:
        marked = pages.join(F.broadcast(per_host), "_tw_host", "left")
    else:
        marked = skew_join(pages, per_host, "_tw_host", "_tw_pages", "left")
    lines = F.split(F.col(text_col), "\n")
    known = F.coalesce("_tw_lines", F.array().cast("array<bigint>"))
    # a blank line hashes like "", which is never among the known
    kept = F.filter("_tw_split", lambda x: ~F.array_contains(known, F.xxhash64(_bare(x))))
    touched = F.col("_tw_lines").isNotNull() & F.col(text_col).isNotNull()
    columns = [c for c in pages.columns if c not in ("_tw_host", text_col)]
    out = marked.withColumn("_tw_split", lines).withColumn("_tw_kept", F.when(touched, kept).otherwise(F.col("_tw_split")))
    n_lines = F.coalesce(F.size("_tw_split"), F.lit(0))
    text = F.when(touched, F.array_join("_tw_kept", "\n")).otherwise(F.col(text_col))
    order = [c for c in pages.columns if c != "_tw_host"]
    return out.select(
        *columns, text.alias(text_col), F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).alias("n_lines"),
        F.when(touched, F.size("_tw_split") - F.size("_tw_kept")).otherwise(F.lit(0)).alias("n_dropped"),
    ).select(*order, "n_lines", "n_dropped")

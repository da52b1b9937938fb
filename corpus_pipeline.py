"""From documents to token ids: the stages of the corpus pipeline, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.bpe import encode_and_decode
from twinfold.llm.mixing import mix_sources, plan_mixture
from twinfold.llm.quality import THRESHOLD, quality_score, train_quality
from twinfold.llm.queries import held_out, table, tokenizer
from twinfold.llm.shingle_join import similar_documents
from twinfold.llm.site_lines import drop_boilerplate
from twinfold.operators.scratch import materialize

MIX_ENTROPY, MIX_REPEATS = 0.95, 1.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A null text is scored as an empty one; every row
    is judged by its text alone, whatever its id; without labels nothing is rejected."""
    labels = table(spark, sf_dir, "labels")
    model = train_quality(docs, labels, "doc_id", "text", "quality", ~held_out(F.col("doc_id")))
    return docs.withColumn("_tw_score", quality_score(F.col("text"), model)).where(
        F.col("_tw_score") >= THRESHOLD).drop("_tw_score")


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source. Every row stays, null texts as
    they are; documents without a source lose nothing; ``n_chars`` follows the text."""
    cleaned = drop_boilerplate(docs, "source", "text").select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles,
    similarity 0.8.

    Rows are told apart by a number of their own, not by their id: rows of one id with different
    texts are different documents, repeated rows are near duplicates, of which one stays. A row
    with a null id stays only where its group has no other id. Texts without words are near to nothing.
    """
    rows = materialize(docs.withColumn("_tw_row", F.monotonically_increasing_id()), "numbered")
    groups = similar_documents(rows, "_tw_row", "text", 5, 0.8).where("n_shingles > 0").select(
        F.col("id").alias("_tw_row"), F.col("component_id").alias("_tw_group"))
    grouped = groups.where(F.col("_tw_row") != F.col("_tw_group")).select("_tw_group").distinct()
    members = materialize(groups.join(grouped, "_tw_group", "left_semi"), "near-duplicates")
    ranked = rows.select("_tw_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_tw_row").alias("_tw_rank")).join(members, "_tw_row")
    first = ranked.groupBy("_tw_group").agg(F.min("_tw_rank")["_tw_row"].alias("_tw_row"))
    others = materialize(members.join(first, "_tw_row", "left_anti").select("_tw_row"), "others")
    return rows.join(others, "_tw_row", "left_anti").select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in which the largest source is read once and smaller ones up to 1.5 times, so
    every document with tokens stays; documents repeat as their source does. A null source is a
    source; null and wordless texts weigh nothing and come with each whole pass of their source; a source
    without any token is left out; equal rows are read equally often."""
    plan = plan_mixture(docs, "doc_id", "source", "text", MIX_ENTROPY, MIX_REPEATS, None)
    return mix_sources(docs, "doc_id", "source", plan).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (32 bits, little-endian) and the digest of what they decode to, a row
    per row: null texts have no ids, null and repeated ids change nothing."""
    decoded = encode_and_decode(docs, "doc_id", "text", tokenizer("byte_bpe_50k.json"))
    return decoded.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("site_lines", drop_site_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("tokens", to_tokens),
]

ORACLE_SQL = None  # a learned classifier and byte-pair encoding: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents at ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

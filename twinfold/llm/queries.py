"""The registered queries of these operators, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.scratch import scratch_root

from .bpe import encode_and_decode
from .conversations import conversation_report, damage_conversations, repair_conversations
from .fm_index import WINDOW, find_contamination
from .mixing import mix_sources, plan_mixture
from .near_vectors import near_vectors
from .quality import THRESHOLD, quality_score, train_quality
from .secrets_crf import find_secrets, train_secrets
from .sharding import assign_shards
from .shingle_join import similar_documents
from .site_lines import BOILERPLATE_RATIO, LEAST_PAGES, drop_boilerplate
from .token_files import read_files, write_files
from .vp_trees import nearest
from .whitening import whiten

MIX_ENTROPY, MIX_REPEATS, MIX_BUDGET = 0.95, 4.0, 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str, path: str | None = None) -> str:
    """Content of a public tokenizer's file; ``path`` names another place of it."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_text(encoding="utf-8")


def held_out(id_: Column) -> Column:
    """The fold that gives no labels: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", 16)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_p_stable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9).withColumnRenamed("id", "vec_id")


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(documents, "source", "text").select("doc_id", "n_lines", "n_dropped", "text")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    plan = plan_mixture(documents, "doc_id", "source", "text", MIX_ENTROPY, MIX_REPEATS, MIX_BUDGET)
    return mix_sources(documents.select("doc_id", "source"), "doc_id", "source", plan).select(
        "doc_id", "source", F.col("_tw_pass").alias("pass"), F.col("_tw_block").alias("block"), F.col("_tw_place").alias("place"))


def op5_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_quality(documents, labels, "doc_id", "text", "quality", ~held_out(F.col("doc_id")))
    return documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = encode_and_decode(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("byte_bpe_50k.json"))
    return decoded.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("word_bpe_49k.json"), path)
    return read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 0.85).withColumnRenamed("id", "doc_id")


def op9_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = find_secrets(documents, "doc_id", "text", train_secrets(documents, "doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, fitted = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    explained = [float(e) / fitted.trace for e in fitted.values] if fitted else []
    return found.select("id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("_at") + 1).alias("component"), F.lit(fitted.rows if fitted else 0).cast("bigint").alias("n"),
        "deviation", "whitened", F.get(F.lit(explained).cast("array<double>"), F.col("_at")).alias("explained"),
        F.lit(fitted.identity_error if fitted else 0.0).alias("identity_error"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    columns = ("conv_id", "turn", "role", "text")
    report = conversation_report(repair_conversations(damage_conversations(rows, *columns), *columns))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = report.withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    return every.join(told, every["conv_id"].eqNullSafe(told["_conv"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sampled_splitters, op2_p_stable_vectors, op3_site_lines, op4_temperature_mixing, op5_positive_unlabelled,
        op6_backtracking_bpe, op7_patched_frames, op8_parity_sketch_join, op9_vantage_point_trees, op10_secret_field,
        op11_fm_index, op12_block_whitening, op13_conversation_repair)
}

_BARE_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_COMPONENTS = """
walk(a, b) AS (
    SELECT id, id FROM nodes
    UNION SELECT w.a, l.b FROM walk w JOIN both_ways l ON w.b = l.a
),
component AS (SELECT a AS id, min(b) AS component_id FROM walk GROUP BY a)
"""

ORACLE: dict[str, str] = {
    "op2_p_stable_vectors": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
valid AS (
    SELECT * FROM nodes WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
),
both_ways AS (
    SELECT x.id AS a, y.id AS b FROM valid x JOIN valid y ON x.id <> y.id
    WHERE list_cosine_similarity(x.v, y.v) >= 0.9
),
{_COMPONENTS}
SELECT n.id AS vec_id, count(l.b) AS n_links, any_value(c.component_id) AS component_id,
    n.id = any_value(c.component_id) AS kept
FROM nodes n JOIN component c ON c.id = n.id LEFT JOIN both_ways l ON l.a = n.id GROUP BY n.id
""",
    "op3_site_lines": f"""
WITH lines AS (
    SELECT doc_id, source, nr, line, trim(line, chr(32) || chr(9) || chr(13)) AS bare FROM (
        SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS nr FROM documents WHERE text IS NOT NULL)
),
totals AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
common AS (
    SELECT l.source, bare FROM lines l JOIN totals t ON t.source = l.source WHERE bare <> ''
    GROUP BY l.source, bare, t.n
    HAVING count(DISTINCT doc_id) >= {LEAST_PAGES} AND count(DISTINCT doc_id) > {BOILERPLATE_RATIO} * t.n
),
marked AS (
    SELECT l.*, EXISTS (SELECT 1 FROM common c WHERE c.source = l.source AND c.bare = l.bare) AS dropped FROM lines l
),
told AS (
    SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS INT) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT dropped), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, t.text
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
""",
    "op4_temperature_mixing": f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce('s' || source, 'null') AS key, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n FROM documents
),
totals AS (
    SELECT key, sum(n) AS tokens, sum(n) / (SELECT sum(n) FROM docs) AS share,
        least(greatest(CAST(ceil(sum(n) / 1000000.0) AS BIGINT), 1), 10000) AS n_blocks FROM docs GROUP BY key
),
given AS (
    SELECT list(CAST(share AS DOUBLE) ORDER BY key) AS p, list(CAST(tokens AS DOUBLE) ORDER BY key) AS t,
        sum(tokens) * CAST({MIX_BUDGET} AS DOUBLE) AS budget FROM totals WHERE tokens > 0
),
even(i, low, high) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT i + 1, CASE WHEN h >= {MIX_ENTROPY} THEN mid ELSE low END, CASE WHEN h >= {MIX_ENTROPY} THEN high ELSE mid END
    FROM (
        SELECT *, CASE WHEN len(p) < 2 THEN 1 ELSE (ln(z) - list_sum(list_transform(q, lambda x: x * ln(x))) / z) / ln(len(p)) END AS h
        FROM (SELECT *, list_sum(q) AS z FROM (
            SELECT i, low, high, (low + high) / 2 AS mid, p, list_transform(p, lambda x: pow(x, (low + high) / 2)) AS q
            FROM even, given WHERE i < 40)))
),
first_choice AS (
    SELECT CASE WHEN len(p) < 2 OR -list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(p)) >= {MIX_ENTROPY}
        THEN 1.0 ELSE low END AS e FROM given, even WHERE i = 40
),
repeats AS (
    SELECT e, list_max(list_transform(list_zip(p, t), lambda x: pow(x[1], e) / x[2]))
        / list_sum(list_transform(p, lambda x: pow(x, e))) * budget > {MIX_REPEATS} AS too_many FROM first_choice, given
),
bounded(i, low, high) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT i + 1, CASE WHEN r > {MIX_REPEATS} THEN mid ELSE low END, CASE WHEN r > {MIX_REPEATS} THEN high ELSE mid END
    FROM (
        SELECT i, low, high, (low + high) / 2 AS mid,
            list_max(list_transform(list_zip(p, t), lambda x: pow(x[1], (low + high) / 2) / x[2]))
            / list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))) * budget AS r
        FROM bounded, given WHERE i < 40)
),
chosen AS (SELECT CASE WHEN too_many THEN least(1.0, low + pow(2, -40)) ELSE e END AS e FROM repeats, bounded WHERE i = 40),
planned AS (
    SELECT key, tokens, n_blocks, CASE WHEN tokens = 0 THEN 0 ELSE CAST(floor(
        pow(share, e) / list_sum(list_transform(p, lambda x: pow(x, e))) * budget) AS BIGINT) END AS quota
    FROM totals, chosen, given
),
passes AS (
    SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE CAST(quota AS BIGINT) // CAST(tokens AS BIGINT) END AS whole FROM planned
),
placed AS (
    SELECT d.doc_id, d.source, d.key, d.n, p.whole, CAST(p.quota - p.whole * p.tokens AS BIGINT) AS rest, s.pass,
        substr(md5(d.key || '|' || s.pass || '|' ||
            (CAST('0x' || substr(md5(d.id), 1, 8) AS BIGINT) % p.n_blocks)), 1, 16) AS block,
        substr(md5(d.key || '|' || s.pass || '|' || d.id), 1, 16) AS place
    FROM docs d JOIN passes p ON p.key = d.key CROSS JOIN LATERAL (SELECT unnest(range(CAST(p.whole + 1 AS BIGINT))) AS pass) s
),
running AS (
    SELECT *, sum(n) OVER (PARTITION BY key, pass ORDER BY block, place) AS upto FROM placed
),
cut AS (
    SELECT key, min(block || place) AS ending FROM running WHERE pass = whole AND upto > rest GROUP BY key
)
SELECT r.doc_id, r.source, r.pass, r.block, r.place FROM running r LEFT JOIN cut c ON c.key = r.key
WHERE r.pass < r.whole OR r.block || r.place < c.ending
""",
    "op8_parity_sketch_join": f"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
    FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
nodes AS (SELECT w.id, count(s.s) AS n FROM words w LEFT JOIN shingles s ON s.id = w.id GROUP BY w.id),
shared AS (
    SELECT x.id AS a, y.id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id
),
both_ways AS (
    SELECT a, b FROM shared JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
{_COMPONENTS}
SELECT n.id AS doc_id, n.n AS n_shingles, c.component_id FROM nodes n JOIN component c ON c.id = n.id
""",
    "op11_fm_index": f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_BARE_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BARE_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS phrase FROM (
        SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
grams AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT r, i, g.n, item FROM grams g JOIN windows w ON g.phrase = w.phrase AND g.n = w.n),
hits AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + n)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hits h ON h.r = d.r LEFT JOIN named i ON i.r = d.r
""",
    "op13_conversation_repair": """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
),
kinds AS (
    SELECT c.*, xor(list_reduce(
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
            lambda x: CAST(ord(x) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS kind
    FROM conversations c, crc
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM kinds, (SELECT unnest(range(2)) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
        coalesce(left(role, 1), '') AS initial,
        rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
),
judged AS (
    SELECT *, bare = '' AS blank, bare <> '' AND again > 1 AS duplicate,
        bare <> '' AND again = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM placed)
),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
        count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
        count(*) FILTER (WHERE truncated) AS truncated,
        count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
),
inserts(s, letters, to_s, lines) AS (
    VALUES (0, '', 0, ''), (1, '', 1, ''), (2, '', 2, ''), (3, '', 3, ''),
        (0, 'I', 2, '|user:'), (1, 'I', 2, '|user:'), (2, 'I', 3, '|assistant:'), (3, 'I', 2, '|user:'),
        (0, 'II', 3, '|user:|assistant:'), (1, 'II', 3, '|user:|assistant:'),
        (2, 'II', 2, '|assistant:|user:'), (3, 'II', 3, '|user:|assistant:')
),
edits(letter, s, initial, to_s, role, cost) AS (
    VALUES ('D', 0, NULL, 0, NULL, 2), ('D', 1, NULL, 1, NULL, 2), ('D', 2, NULL, 2, NULL, 2), ('D', 3, NULL, 3, NULL, 2),
        ('K', 0, 's', 1, NULL, 0), ('K', 0, 'u', 2, NULL, 0), ('K', 1, 'u', 2, NULL, 0), ('K', 3, 'u', 2, NULL, 0),
        ('K', 2, 'a', 3, NULL, 0), ('R', 0, NULL, 2, 'user', 1), ('R', 1, NULL, 2, 'user', 1), ('R', 3, NULL, 2, 'user', 1),
        ('R', 2, NULL, 3, 'assistant', 1)
),
walk(conv_id, i, s, cost, audit, repaired) AS (
    SELECT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', '' FROM counted
    UNION ALL
    SELECT conv_id, i, s, cost, audit, repaired FROM (
        SELECT w.conv_id, j.i, e.to_s AS s, w.audit || k.letters || e.letter AS audit,
            w.cost + 5 * len(k.letters) + e.cost + CASE WHEN j.truncated AND e.letter <> 'D' THEN 5 ELSE 0 END AS cost,
            w.repaired || replace(k.lines, '|', chr(10)) || CASE WHEN e.letter = 'D' THEN '' ELSE
                chr(10) || coalesce(e.role, j.role) || ':' || j.text END AS repaired,
            row_number() OVER (PARTITION BY w.conv_id, e.to_s ORDER BY
                w.cost + 5 * len(k.letters) + e.cost + CASE WHEN j.truncated AND e.letter <> 'D' THEN 5 ELSE 0 END,
                w.audit || k.letters || e.letter) AS nth
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
            JOIN inserts k ON k.s = w.s JOIN edits e ON e.s = k.to_s
        WHERE (e.letter = 'D' OR NOT (j.blank OR j.duplicate)) AND (e.letter <> 'K' OR e.initial = j.initial)
    ) WHERE nth = 1
),
solved AS (
    SELECT conv_id, cost, audit, repaired FROM (
        SELECT w.conv_id, w.cost + 5 * len(k.letters) AS cost, w.audit || k.letters AS audit,
            w.repaired || replace(k.lines, '|', chr(10)) AS repaired,
            row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * len(k.letters), w.audit || k.letters) AS nth
        FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
            JOIN inserts k ON k.s = w.s AND k.to_s IN (0, 3)
    ) WHERE nth = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
    sha256(substr(coalesce(repaired, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN solved v ON v.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}

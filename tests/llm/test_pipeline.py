"""The stages of the pipeline with awkward rows, and their decisions against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from twinfold.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE + " more"
OTHER = " ".join(f"other{i}" for i in range(40))
ROWS = [
    (1, BASE, "en", "a"), (2, NEAR, "en", "a"), (2, OTHER, "en", "a"), (None, BASE, None, "b"), (None, BASE, None, "b"),
    (3, None, None, None), (4, "", "de", "b"), (5, " \n\t", "de", "b"), (6, "short", "de", "c"), (6, "short", "de", "c"),
    (None, "alone and without an id but with words enough", "en", None), (7, "long text here. " * 40_000, "en", "c"),
    (8, "Line of all.\nown eight", "en", "a"), (9, "Line of all.\nown nine", "en", "a"), (10, "Line of all.\nown ten", "en", "a"),
]
CLASHING = ["id", "n", "key", "row", "component_id", "score", "n_shingles", "pass", "n_lines", "digest", "_row"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r[:4], len(r[1]) if r[1] is not None else None) for r in ROWS]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHING))


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicates_are_told_apart_by_row(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    wanted = Counter((r[0], r[1]) for r in ROWS)
    for gone in ((2, NEAR), (None, BASE), (None, BASE), (6, "short")):
        wanted[gone] -= 1
    assert rows_of(kept) == +wanted  # the other text of id 2 stays, and one of the equal rows of id 6


def test_every_stage_takes_awkward_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        found = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name != "tokens":
            assert out.columns == docs.columns
        if name in ("site_lines", "tokens"):
            assert found == Counter(r[0] for r in ROWS)
        none = stage(spark, docs.where("false"), SMALL)
        assert none.columns == out.columns and none.collect() == []


def test_tokens_of_every_row(spark, docs):
    library = Tokenizer.from_str(tokenizer("byte_bpe_50k.json"))
    wanted = Counter()
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in corpus_pipeline.to_tokens(spark, docs, SMALL).collect())
    assert got == wanted


def test_mixing_reads_rows_by_source(spark, docs):
    mixed = corpus_pipeline.mix_to_weights(spark, docs, SMALL)
    found = rows_of(mixed)
    for doc_id, text, _, source in ROWS:
        if text and text.split():
            assert found[doc_id, text] >= 1, (doc_id, source)


def test_one_document_of_each_group_stays(spark):
    """Against all pairs: of the components of similar documents the one of the smallest id stays."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = {}
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        grams = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        sets[r.doc_id] = grams
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({find(i) for i in ids})

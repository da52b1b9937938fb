"""Decontamination, whitening and conversation repair against brute force, with awkward rows: nulls in
any column, empty and very long texts, repeated rows, ties, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from twinfold.llm import conversations as talk
from twinfold.llm import fm_index as fm
from twinfold.llm import whitening
from twinfold.llm.queries import op11_fm_index, op12_block_whitening, op13_conversation_repair

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ["id", "name", "seg", "pos", "mark", "x", "index", "slab", "spans", "items", "whole", "_tw"]


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def clash(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHING if c not in df.columns))


# ---------------------------------------------------------------- decontamination


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def occurrences(text, items, window):
    """(words, hit places, names of the items found) by looking at every place."""
    own, hit, names = words(text), set(), set()
    places = defaultdict(list)
    for n in {min(len(words(t)), window) for _, t in items}:
        for i in range(len(own) - n + 1):
            places[tuple(own[i:i + n])].append(i)
    for name, item in items:
        theirs = words(item)
        for k in range(max(len(theirs) - window + 1, 1) if theirs else 0):
            phrase = tuple(theirs[k:k + window])
            for i in places.get(phrase, ()):
                hit |= set(range(i, i + len(phrase)))
                names |= {name} - {None}
    return own, hit, sorted(names)


def test_suffixes_are_sorted_up_to_the_end_of_their_run():
    draw = random.Random(1)
    for _ in range(300):
        symbols = draw.randint(1, 5)
        text = [draw.randint(0, symbols) for _ in range(draw.randint(0, 80))] + [0]
        wanted = sorted(range(len(text)), key=lambda i: (text[i:text.index(0, i)] + [0], i))
        assert fm.suffix_array(np.array(text, dtype=np.int32), symbols).tolist() == wanted


def test_ranks_of_a_wavelet_matrix():
    draw = np.random.default_rng(2)
    row = draw.integers(0, 23, 500)
    matrix = fm.WaveletMatrix(row, 5)
    symbols, places = draw.integers(0, 32, 200), draw.integers(0, 501, 200)
    assert matrix.rank(symbols, places).tolist() == [int((row[:p] == s).sum()) for s, p in zip(symbols, places, strict=True)]
    found, before = matrix.symbol_and_rank(np.arange(500))
    assert found.tolist() == row.tolist()
    assert before.tolist() == [int((row[:p] == s).sum()) for p, s in enumerate(row)]


ITEMS = [(1, "a b c d e f"), (10, "x"), (2, "A-B-C-D"), (2, "A-B-C-D"), (3, None), (4, " .,"), (None, "null item id é"), (5, "end of all")]
TEXTS = [
    "we see a b, c d e here", "X marks x", None, "", " . ", "null ITEM id é", "a b c", "end", "of all", "end of all", "a b c d " * 5000,
    "b c d e f b c d e f", "end of all", "É xé ax",
]


def test_contamination_against_looking_everywhere(spark):
    docs = clash(spark.createDataFrame(
        [*enumerate(TEXTS), (3, "a b c d"), (3, "a b c d"), (None, "x")], "doc_id bigint, text string").repartition(3))
    items = clash(spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    named = [(None if i is None else str(i), t) for i, t in ITEMS]
    for options in ({}, {"shard_bytes": 5}, {"block_bytes": 30}):
        got = fm.find_contamination(docs, "doc_id", "text", items, "item_id", "text", 4, **options).collect()
        assert len(got) == len(TEXTS) + 3
        by_row = sorted(((r.id is None, r.id or 0, r.n_words, r.n_hit, r["items"]) for r in got), key=str)
        wanted = []
        for i, text in [*enumerate(TEXTS), (3, "a b c d"), (3, "a b c d"), (None, "x")]:
            own, hit, names = occurrences(text, named, 4)
            wanted.append((i is None, i or 0, len(own), len(hit), names))
        assert by_row == sorted(wanted, key=str)
        for r in got:
            if r.id is not None and r.id != 3:
                text = TEXTS[r.id] or ""
                cut = [w for s in r.spans for w in words(text[s.start:s.end])]
                own, hit, _ = occurrences(text, named, 4)
                assert cut == [own[i] for i in sorted(hit)]
                assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    cleaned = fm.remove_contamination(docs, "text", items, "item_id", "text", 4)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    texts = {r.doc_id: r.text for r in cleaned.where("doc_id > 3").collect()}
    assert texts[5] == "" and texts[7] == "end" and texts[9] == "" and texts[13] == TEXTS[13]
    none = fm.find_contamination(docs, "doc_id", "text", items.where("false"), "item_id", "text")
    assert none.agg(F.sum("n_hit")).first()[0] == 0 and none.count() == docs.count()
    assert fm.find_contamination(docs.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0


def test_contamination_of_all_documents(spark):
    items = [(str(r.item_id), r.text) for r in table(spark, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    rows = op11_fm_index(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own, hit, names = occurrences(texts[r.doc_id], items, fm.WINDOW)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(own), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert any(r.contaminated for r in rows)


# ---------------------------------------------------------------- whitening


def test_whitening_of_all_vectors(spark):
    vectors = {r.vec_id: np.floor(64 * np.array(r.embedding, dtype=float)).astype(np.int64) + 1_000_000
               for r in table(spark, "embeddings").collect()}
    x = np.array([vectors[k] for k in sorted(vectors)])
    n, sums = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    rows = op12_block_whitening(spark, SMALL).collect()
    assert len(rows) == 32 * n and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-4
    turned = {(r.vec_id, r.component): r.whitened for r in rows}
    for r in rows:
        assert r.deviation == int(((n * vectors[r.vec_id] - sums) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    expected = (x - sums / n) @ axes[:, :32] / np.sqrt(values[:32])
    got = np.array([[turned[k, c] for c in range(1, 33)] for k in sorted(vectors)])
    assert np.abs(np.abs(got) - np.abs(expected)).max() < 1e-6
    assert all(np.allclose(got[:, c], expected[:, c]) or np.allclose(got[:, c], -expected[:, c]) for c in range(32))


def test_slabs_change_nothing(spark):
    df = table(spark, "embeddings")
    one, fit_one = whitening.whiten(df, "vec_id", "embedding", 5)
    many, fit_many = whitening.whiten(df, "vec_id", "embedding", 5, block_rows=16, slab_blocks=4)
    assert fit_one.sums == fit_many.sums and np.allclose(fit_one.values, fit_many.values)
    a, b = ({r.id: np.abs(r.whitened) for r in rows.collect()} for rows in (one, many))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert max(fit_one.identity_error, fit_many.identity_error) < 1e-9


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
            (5, []), (6, [1.0]), (7, [float("inf"), 0.0])]
    odd = clash(spark.createDataFrame(rows, "vec_id bigint, v array<float>"))
    found, fitted = whitening.whiten(odd, "vec_id", "v")
    got = sorted(((r.id, r.deviation, round(r.whitened[0] / abs(r.whitened[0]))) for r in found.collect()), key=str)
    assert fitted.rows == 3 and {g[:2] for g in got} == {(1, 53248), (None, 212992)} and len(got) == 3
    huge = odd.unionByName(clash(spark.createDataFrame([(8, [1e30, 0.0])], "vec_id bigint, v array<float>")))
    assert {r.deviation for r in whitening.whiten(huge, "vec_id", "v")[0].collect()} == {None}  # beyond 64 bits
    for same in (odd.where("vec_id = 1"), odd.where("vec_id = 2"), odd.where("false")):
        found, fitted = whitening.whiten(same, "vec_id", "v")
        assert fitted is None and found.collect() == []


# ---------------------------------------------------------------- conversations


def cheapest(rows):
    """Least (cost, audit, repaired rows) by carrying whole texts, for (role, text, must go, truncated)."""
    def with_inserts(paths):
        found = list(paths)
        for _ in range(3):
            paths = [(c + 5, a + "I", out + [(talk.ROLES[talk.NEXT[s]], "")], talk.STATE_OF[talk.NEXT[s]]) for c, a, out, s in paths]
            found += paths
        return found

    paths = [(0, "", [], 0)]
    for role, text, must_go, truncated in rows:
        best = {}
        for cost, audit, out, s in with_inserts(paths):
            ways = [(cost + 2, audit + "D", out, s)]
            if not must_go:
                more = cost + 5 * truncated
                first, due = (role or "")[:1], talk.NEXT[s]
                if first == due:
                    ways.append((more, audit + "K", out + [(role, text)], talk.STATE_OF[due]))
                if first == "s" and s == 0:
                    ways.append((more, audit + "K", out + [(role, text)], 1))
                ways.append((more + 1, audit + "R", out + [(talk.ROLES[due], text)], talk.STATE_OF[due]))
            for way in ways:
                if way[3] not in best or way[:2] < best[way[3]][:2]:
                    best[way[3]] = way
        paths = list(best.values())
    return min((p for p in with_inserts(paths) if p[3] in (0, 3)), key=lambda p: p[:2])


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = (text or "").rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        found.append(fault)
        seen.add((role, text))
    return found


def expected_report(rows):
    """All columns of a conversation from its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))
    found = faults([r[1:] for r in rows])
    cost, audit, out, _ = cheapest([
        (role, text, f in ("blank", "duplicate"), f == "truncated") for (_, role, text), f in zip(rows, found, strict=True)])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [(role or "")[:1] for _, role, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"),
        found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 and text is not None else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


COLUMNS = ("conv_id", "turn", "role", "text")
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_reports(rows, got):
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    assert {r.conv_id for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        assert tuple(r[f] for f in FIELDS) == expected_report(groups[r.conv_id]), r.conv_id


def test_crossings_give_the_least_text_of_the_cheapest_paths():
    draw = random.Random(3)
    for trial in range(600):
        rows = [(draw.choice("sua" if trial % 2 else ["u", "a", ""]), draw.random() < 0.2, draw.random() < 0.2)
                for _ in range(draw.randint(0, 30))]
        rows = [(i, gone, cut and not gone) for i, gone, cut in rows]
        states = talk.crossings([talk.row_step(*r) for r in rows], talk.NOTHING, talk.FINISH)
        audit = "".join(talk.edits_of(rows, states, talk.NOTHING)) + talk.ENDINGS[states[-1] if states else 0]
        assert audit == cheapest([(i, "t", gone, cut) for i, gone, cut in rows])[1]
        parts = [rows[k:k + 4] for k in range(0, len(rows), 4)]  # segments give the same states
        joint = talk.crossings([talk.joint_step([talk.row_step(*r) for r in p]) for p in parts], talk.NOTHING, talk.FINISH)
        assert joint == [states[min(k + 3, len(rows) - 1)] for k in range(0, len(rows), 4)]


def test_repair_of_awkward_conversations(spark, monkeypatch):
    draw = random.Random(4)
    texts = ["Hello.", "hello", "Why?", " \n\t", "", None, "Same. ", "Yes!\r", "été."]
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([None, *range(12)]), draw.choice(["user", "assistant", "system", "tool", "agent", "", None]),
             draw.choice(texts)) for _ in range(150)]
    rows += [(7, k, "user" if k % 2 else "assistant", f"turn {k}.") for k in range(40)] + [(8, None, None, None)] * 3
    rows += [(9, 0, "user", "long text. " * 50_000), (9, 1, "assistant", "ok.")]
    df = clash(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3))
    check_reports(rows, talk.conversation_report(talk.repair_conversations(df, *COLUMNS)).collect())
    pieces = talk.repair_conversations(df, *COLUMNS)
    lines = talk.repaired_rows(pieces).where("conv_id = 9").orderBy("seg", "place").collect()
    assert [(r.role, r.text) for r in lines] == [("user", rows[-2][3]), ("assistant", "ok.")]
    none = talk.repair_conversations(df.where("false"), *COLUMNS)
    assert none.collect() == [] and talk.conversation_report(none).collect() == []


def test_a_conversation_of_many_segments(spark):
    """Some 20,000 rows of one conversation, with many equal rows, over several tasks and segments."""
    draw = random.Random(5)
    rows = [(1, draw.randint(0, 15_000), draw.choice(["user", "assistant", "system"]), draw.choice(["Same text.", f"own {k}.", f"cut {k}"]))
            for k in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    pieces = talk.repair_conversations(df, *COLUMNS)
    assert pieces.count() >= 20_000 // talk.SEGMENT_ROWS
    report = talk.conversation_report(pieces).collect()
    check_reports(rows, report)


def test_repair_of_all_conversations(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select(*COLUMNS).collect()]
    got = {r.conv_id: r for r in op13_conversation_repair(spark, SMALL).collect()}
    damaged = list(damage(rows))
    check_reports(damaged, [r for c, r in got.items() if c in {d[0] for d in damaged}])
    assert set(got) == {r[0] for r in rows}
    odd = [(None, None, None, None), (1, None, "user", "A. b! c?"), *[(2, k, "user", "A. b! c?") for k in range(60)]]
    df = clash(spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string"))
    found = talk.damage_conversations(df, *COLUMNS)
    assert found.columns == df.columns
    assert sorted(map(str, (tuple(r)[:4] for r in found.collect()))) == sorted(map(str, damage(odd)))

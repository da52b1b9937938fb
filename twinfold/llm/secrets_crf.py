"""Secrets found by patterns and by a linear-chain conditional random field.

Three patterns give the base. The field tags every token of a text as begin, inside or outside of a
secret from its shape, the neighbouring words and features of the file, and adds spans that no
pattern covers. Labels come from two sources, so that the field does not merely learn the patterns: base
matches of a bounded sample, as they stand and once more with the word that the pattern goes by
replaced; and random values planted into ordinary texts of the sample, under names and in
phrases that no pattern takes. Decoding is Viterbi. A token whose lead for outside exceeds all that its
neighbours could make up for is outside on the best path, so the search runs on the stretches
between such tokens only, with the same result.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import prepare, released

# The base patterns and the least lengths of what they take.
KINDS = ["assign", "access", "hex"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LEAST = {"assign": 12, "access": 18, "hex": 16}
_MAY_MATCH = re.compile(r"password|passwd|secret|token|api_?key|(?-i:AKIA)|(?-i:[0-9a-f]{16})", re.I | re.A).search

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_NAMING = {"password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "auth", "bearer",
           "credential", "credentials", "private", "access"}
_SIGNS = "=:\"'-_/+.,@"
_CHARSETS = ["lower", "capital", "upper", "digits", "hex", "lower-digits", "upper-digits", "mixed-digits", "mixed", "other"]
_LENGTHS = [1, 2, 4, 8, 12, 16, 20, 32]
_N_OWN = len(_CHARSETS) * len(_LENGTHS) + len(_SIGNS) + 1 + 1  # the last is the border of a text
_BORDER = _N_OWN - 1
_ROUGH = ["border", "naming", "assigns", "quote", "sign", "word", "number", "odd"]
_REACH = 4  # tokens back to a naming word
_N_FILE = 4
B, INSIDE, OUT = 0, 1, 2

MOST_SAMPLED = 2_500  # documents with a base match from which training windows come, and as many others
# What planted values are called, the phrases they stand in, and their letters.
NAMES = ["pwd", "pass", "passphrase", "credential", "auth", "bearer", "private_key", "access", "key", "login", "pin", "signature"]
PHRASES = ["{n} = {v}", "{n}: {v}", "{n}={v}", "{n}='{v}'", '"{n}": "{v}"', "{n} is {v}", "the {n} {v}", "Bearer {v}", "{n} -> {v}", "{v}", "({v})"]
_MIXED = string.ascii_letters + string.digits
LETTERS = [_MIXED, _MIXED, _MIXED + "+/", _MIXED + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
VALUE_LENGTHS = (16, 44)
WINDOW = 15  # tokens on either side of a match
MOST_PER_DOCUMENT = 4  # windows around matches that one document gives to the training
STEPS, RATE, DECAY = 120, 0.15, 2e-3
MOST_CACHED = 300_000
BATCH_TOKENS = 1_000_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start, then kind as listed; code points."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= _LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _shape(token: str) -> tuple[int, int]:
    """(own category, rough category) of a token."""
    if not token[0].isalnum():
        sign = _SIGNS.find(token)
        own = len(_CHARSETS) * len(_LENGTHS) + (sign if sign >= 0 else len(_SIGNS))
        return own, _ROUGH.index("assigns" if token in "=:" else "quote" if token in "\"'" else "sign")
    if token.isascii():
        digits = not token.isalpha()
        lower, upper = token != token.upper(), token != token.lower()
    else:
        digits = any(c.isdigit() for c in token)
        lower, upper = any(c.islower() for c in token), any(c.isupper() for c in token)
    if digits and not lower and not upper:
        charset = "digits"
    elif digits and lower and upper:
        charset = "mixed-digits"
    elif digits and lower:
        charset = "hex" if set(token) <= set("0123456789abcdef") else "lower-digits"
    elif digits:
        charset = "upper-digits"
    elif lower and upper:
        charset = "capital" if token[1:].islower() else "mixed"
    else:
        charset = "lower" if lower else "upper" if upper else "other"
    length = bisect_right(_LENGTHS, len(token)) - 1
    own = _CHARSETS.index(charset) * len(_LENGTHS) + length
    if token.lower() in _NAMING:
        return own, _ROUGH.index("naming")
    rough = "number" if charset == "digits" else "odd" if digits else "word"
    return own, _ROUGH.index(rough)


class _Shapes(dict):
    """Own and rough category of a token, a byte each."""

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        got = bytes(_shape(token))
        if len(token) <= 64:
            self[token] = got
        return got


_shapes = _Shapes()


class _Units(dict):
    """Of what stands between white space: own, rough category and whether a pattern may match, a
    byte each, for every token."""

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        may = b"\1" if _MAY_MATCH(unit) else b"\0"
        got = b"".join([_shapes[t] + may for t in _TOKEN.findall(unit)])
        if len(unit) <= 64:
            self[unit] = got
        return got


_units = _Units()


def _forget_units() -> None:
    _units.clear()
    _shapes.clear()


_GAP = bytes((_BORDER, 0, 0)) * _REACH


def _categories(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (own, rough, may match) of the tokens of all texts with a border before each text and
    at the end; and where each text begins."""
    parts = [_GAP]
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    at = _REACH
    for i, text in enumerate(texts):
        own = b"".join(map(_units.__getitem__, text.split()))
        parts += [own, _GAP]
        begin[i] = at
        at += len(own) // 3 + _REACH
    begin[-1] = at
    return np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, 3), begin


def _features(table: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Indices into the weights for each token: own, two words before, one after, naming word near
    before, file; the file has a naming word or not, and many digits or not."""
    own, rough = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64)
    before, before2, after = np.roll(rough, 1), np.roll(rough, 2), np.roll(rough, -1)
    naming = rough == _ROUGH.index("naming")
    near = np.zeros(len(rough), dtype=bool)
    for i in range(1, _REACH + 1):
        near |= np.roll(naming, i)
    counted = np.maximum(np.diff(begin) - _REACH, 1)
    def of_file(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), begin[:-1])

    numeric = (rough == _ROUGH.index("number")) | (rough == _ROUGH.index("odd"))
    kind = (of_file(naming) > 0) * 2 + (of_file(numeric) > 0.1 * counted)
    file = np.zeros(len(rough), dtype=np.int64)
    file[begin[0]:] = np.repeat(kind, np.diff(begin))
    n = len(_ROUGH)
    sizes = np.cumsum([0, _N_OWN, n, n, n, 2])
    return np.stack([own, sizes[1] + before, sizes[2] + before2, sizes[3] + after, sizes[4] + near, sizes[5] + file], axis=1)


N_WEIGHTS = _N_OWN + 3 * len(_ROUGH) + 2 + _N_FILE


@dataclass(frozen=True)
class SecretModel:
    emission: np.ndarray  # weight of every feature for every tag
    transition: np.ndarray  # from a tag (3: the start) to a tag

    def emissions(self, features: np.ndarray) -> np.ndarray:
        total = self.emission[features[:, 0]].copy()
        for i in range(1, features.shape[1]):
            total += self.emission[features[:, i]]
        return total


_FORBIDDEN = -1e4


def _allowed(transition: np.ndarray) -> np.ndarray:
    out = transition.copy()
    out[OUT, INSIDE] = out[3, INSIDE] = _FORBIDDEN
    return out


def viterbi(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best tags of a sequence; of equal paths that with the later tags in the order begin, inside, outside."""
    return viterbi_of_each(scores, np.array([len(scores)]), transition)


def viterbi_of_each(scores: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """``viterbi`` of sequences that stand one behind the other: a step takes one place of all that are as long."""
    order = np.argsort(-sizes, kind="stable")
    first, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    best = transition[3] + scores[first]
    longer = np.searchsorted(-length, -np.arange(1, length[0] + 1))  # so many reach the place
    paths = []
    for t, n in enumerate(longer[:-1].tolist(), start=1):
        step = best[:n, :, None] + transition[:3]
        paths.append(2 - np.argmax(step[:, ::-1], axis=1))
        best[:n] = step.max(axis=1) + scores[first[:n] + t]
    tag = 2 - np.argmax(best[:, ::-1], axis=1)
    tags = np.empty(len(scores), dtype=np.int64)
    tags[first + length - 1] = tag
    for t in range(len(paths), 0, -1):
        n = longer[t - 1]
        tag[:n] = paths[t - 1][np.arange(n), tag[:n]]
        tags[first[:n] + t - 1] = tag[:n]
    return tags


def decode(scores: np.ndarray, model: SecretModel) -> np.ndarray:
    """Best tags of a long sequence whose first and last token are borders, which are outside.

    Take a path with begin or inside at a token, put outside there, and begin at the next token if
    that was inside. The path gains the token's lead for outside, and loses at most ``slack`` in
    transitions and what inside had over begin at the next token. So where the lead is larger, the
    best path is outside.
    """
    trans = _allowed(model.transition)
    slack = 0.0
    for a in range(4):
        for y in (B, INSIDE):
            for b in (B, INSIDE, OUT):
                c = B if b == INSIDE else b
                lost = trans[a, y] - trans[a, OUT] + trans[y, b] - trans[OUT, c]
                after = max(trans[b, z] - trans[c, z] for z in (B, INSIDE, OUT)) if b != c else 0.0
                slack = max(slack, lost + max(after, 0.0))
    inside_lead = np.maximum(np.append(scores[1:, INSIDE] - scores[1:, B], 0), 0)
    sure = scores[:, OUT] - np.maximum(scores[:, B], scores[:, INSIDE]) > slack + inside_lead + 1e-9
    sure[0] = sure[-1] = True
    tags = np.full(len(scores), OUT)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    # stretches between two tokens that are outside for sure
    ends = np.append(np.flatnonzero(np.diff(open_) > 1), len(open_) - 1)
    inner = scores[open_]
    inner[ends] += trans[:3, OUT]
    start = trans.copy()
    start[3] = trans[OUT]
    tags[open_] = viterbi_of_each(inner, np.diff(ends, prepend=-1), start)
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> SecretModel:
    """Conditional likelihood by Adam; ``features`` (windows, places, kinds), ``tags`` (windows,
    places), filled up to one length."""
    count, width, _ = features.shape
    there = np.arange(width)[None, :] < lengths[:, None]
    gold = np.zeros((N_WEIGHTS, 3))
    gold_t = np.zeros((4, 3))
    for k in range(features.shape[2]):
        np.add.at(gold, (features[:, :, k][there], tags[there]), 1)
    np.add.at(gold_t, (3, tags[:, 0]), 1)
    both = there[:, 1:]
    np.add.at(gold_t, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    size = N_WEIGHTS * 3
    w = np.zeros(size + 12)
    m, v = np.zeros_like(w), np.zeros_like(w)
    flat = features[there]
    for step in range(1, STEPS + 1):
        model = SecretModel(w[:size].reshape(-1, 3), w[size:].reshape(4, 3))
        trans = _allowed(model.transition)
        e = np.zeros((count, width, 3))
        e[there] = model.emissions(flat)
        alpha = np.zeros_like(e)
        alpha[:, 0] = trans[3] + e[:, 0]
        for t in range(1, width):
            moved = _logsum(alpha[:, t - 1, :, None] + trans[None, :3], 1) + e[:, t]
            alpha[:, t] = np.where(there[:, t, None], moved, alpha[:, t - 1])
        total = _logsum(alpha[:, -1], 1)
        beta = np.zeros_like(e)
        expected_t = np.zeros((4, 3))
        for t in range(width - 2, -1, -1):
            ahead = (e[:, t + 1] + beta[:, t + 1])[:, None, :] + trans[None, :3]
            pair = np.exp(alpha[:, t, :, None] + ahead - total[:, None, None])
            expected_t[:3] += (pair * there[:, t + 1, None, None]).sum(axis=0)
            beta[:, t] = np.where(there[:, t + 1, None], _logsum(ahead, 2), 0)
        share = np.exp(alpha + beta - total[:, None, None])
        expected_t[3] = share[:, 0].sum(axis=0)
        expected = np.zeros((N_WEIGHTS, 3))
        mass = share[there]
        for k in range(flat.shape[1]):
            for y in range(3):
                expected[:, y] += np.bincount(flat[:, k], mass[:, y], N_WEIGHTS)
        g = np.concatenate([(expected - gold).ravel(), (expected_t - gold_t).ravel()]) / count + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SecretModel(w[:size].reshape(-1, 3), w[size:].reshape(4, 3))


def _windows(text: str, spans: list[tuple[int, int]], middles: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of the tokens around each of the places, with the spans as secrets."""
    table, begin = _categories([text])
    features = _features(table, begin)[_REACH:-_REACH]
    if not len(features):
        return []
    starts = np.array([m.start() for m in _TOKEN.finditer(text)])
    tags = np.full(len(starts), OUT)
    for s, e in spans:
        first, last = np.searchsorted(starts, s), np.searchsorted(starts, e) - 1
        if first <= last:
            tags[first] = B if tags[first] == OUT else tags[first]
            tags[first + 1:last + 1] = INSIDE
    out = []
    for middle in middles:
        at = min(int(np.searchsorted(starts, middle)), len(starts) - 1)
        low, high = max(0, at - WINDOW), min(len(starts), at + 2 * WINDOW)
        own = tags[low:high].copy()
        if own[0] == INSIDE:
            own[0] = B
        out.append((features[low:high], own))
    return out


def _value(draw: random.Random) -> str:
    letters = draw.choice(LETTERS)
    value = "".join(draw.choices(letters, k=draw.randint(*VALUE_LENGTHS)))
    return value if any(c.isdigit() for c in value) else value + draw.choice(string.digits) + draw.choice(letters)


def planted(text: str, draw: random.Random) -> tuple[str, int, int]:
    """The text with a random value in a phrase at a random place between words, and where the value stands."""
    places = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    at = draw.choice(places)
    name = draw.choice(NAMES) if draw.random() < 0.7 else draw.choice(text.split() or ["name"])
    value = _value(draw)
    front, back = draw.choice(PHRASES).replace("{n}", name).split("{v}")
    begin = at + 1 + len(front)
    return f"{text[:at]} {front}{value}{back}{text[at:]}", begin, begin + len(value)


def _training_windows(text: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows around base matches, as they stand and with another word in place of the one the
    pattern goes by; for a text without any, around a planted value, a random place, and a random
    token of letters and digits, which ordinary texts hold too."""
    draw = random.Random(seed)
    base = [(_ASSIGN.match(text, s).start(2) if kind == "assign" else s, s, e, kind) for s, e, kind in base_spans(text)]
    if base:
        chosen = base if len(base) <= MOST_PER_DOCUMENT else draw.sample(base, MOST_PER_DOCUMENT)
        out = _windows(text, [(v, e) for v, _, e, _ in base], [v for v, _, _, _ in chosen])
        for value, s, e, kind in chosen:
            if kind == "assign":
                word = _ASSIGN.match(text, s).group(1)
                other = draw.choice(NAMES)
                moved = len(other) - len(word)
                spans = [(v + moved * (v > s), z + moved * (z > s)) for v, _, z, _ in base]
                out += _windows(text[:s] + other + text[s + len(word):], spans, [value + moved])
        return out
    shown, begin, end = planted(text, draw)
    out = _windows(shown, [(begin, end)], [begin])
    places = [m.start() for m in _TOKEN.finditer(text)]
    if places:
        odd = [p for p in places if (t := _TOKEN.match(text, p).group()).isalnum() and not t.isalpha()]
        out += _windows(text, [], [draw.choice(places), *([draw.choice(odd)] if odd else [])])
    return out


# The base patterns with their least lengths, for the native test of a text.
_HAS_BASE = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
             r"|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")


def train_secrets(documents: DataFrame, id_col: str, text_col: str, most_sampled: int = MOST_SAMPLED) -> SecretModel | None:
    """Fit on windows of about ``most_sampled`` documents with a base match and of as many others at most,
    both by a hash of the row. The driver gets a few windows of some dozen tokens per sampled document.

    Null texts are left out, null and repeated ids and repeated texts do not matter. Without base
    matches, however rare they are, planted values alone teach the field; only without any document with
    words there is no model (None).
    """
    prepare(documents.sparkSession)
    text = F.col(text_col)
    row = F.xxhash64(F.lit(10), F.col(id_col), F.monotonically_increasing_id())
    marked = documents.select(text.alias("text"), text.rlike(_HAS_BASE).alias("weak"), row.alias("row")).where(F.col("text").rlike(r"\S"))
    counts = {r["weak"]: r["count"] for r in marked.groupBy("weak").count().collect()}  # two rows
    draw = F.pmod(F.col("row"), F.lit(1 << 30))

    def bound(weak: bool) -> Column:
        chance = min(1.0, most_sampled / max(counts.get(weak, 0), 1))
        return (F.col("weak") == weak) & (draw < int(chance * (1 << 30)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for text, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                     for w in _training_windows(text, seed)]
            yield pa.RecordBatch.from_arrays([
                pa.array([f.astype("<u2").tobytes() for f, _ in found], pa.binary()),
                pa.array([t.astype("u1").tobytes() for _, t in found], pa.binary())], ["features", "tags"])

    sampled = marked.where(bound(True) | bound(False)).select("text", "row")
    rows = sorted(map(tuple, sampled.mapInArrow(released(windows, _forget_units), "features binary, tags binary").collect()))
    if not rows:
        return None
    tags = [np.frombuffer(bytes(t), "u1").astype(np.int64) for _, t in rows]
    width, kinds = max(map(len, tags)), 6
    x, y = np.zeros((len(rows), width, kinds), dtype=np.int64), np.full((len(rows), width), OUT)
    for i, (f, _) in enumerate(rows):
        x[i, : len(tags[i])] = np.frombuffer(bytes(f), "<u2").reshape(-1, kinds)
        y[i, : len(tags[i])] = tags[i]
    return fit(x, y, np.array(list(map(len, tags))))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BATCH_TOKENS`` tokens, at least one text each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) // 4
        if held >= BATCH_TOKENS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spans_of(texts: list[str], model: SecretModel | None) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text; the field's spans that touch no base span are of kind ``crf``."""
    out = []
    for s, e in _chunks(texts):
        some = texts[s:e]
        table, begin = _categories(some)
        may = np.add.reduceat(table[:, 2].astype(np.int64), begin[:-1]) > 0
        bases = [base_spans(t) if m else [] for t, m in zip(some, may, strict=True)]
        added: list[list[tuple[int, int, str]]] = [[] for _ in some]
        if model is not None:
            tags = decode(model.emissions(_features(table, begin)), model)
            tags[table[:, 0] == _BORDER] = OUT
            tagged = np.flatnonzero(tags != OUT)
            of = np.searchsorted(begin, tagged, side="right") - 1
            for i in np.unique(of):
                own = tagged[of == i] - begin[i]
                where = [m.span() for m in _TOKEN.finditer(some[i])]
                groups = np.split(own, np.flatnonzero((np.diff(own) > 1) | (tags[begin[i] + own[1:]] == B)) + 1)
                for g in groups:
                    a, z = where[g[0]][0], where[g[-1]][1]
                    if not any(x < z and a < y for x, y, _ in bases[i]):
                        added[i].append((a, z, "crf"))
        for base, more in zip(bases, added, strict=True):
            order = [*KINDS, "crf"]
            out.append((base, sorted([*base, *more], key=lambda x: (x[0], order.index(x[2])))))
    return out


def find_secrets(documents: DataFrame, id_col: str, text_col: str, model: SecretModel | None) -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) in code points, end exclusive, by start, then
    kind. Whole texts are read; null counts as empty and has none; every row is returned, whatever its
    id; other columns are ignored."""
    prepare(documents.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of([t or "" for t in batch.column(1).to_pylist()], model)
            columns = [pa.array([[{"kind": k, "start": a, "end": z} for a, z, k in f[n]] for f in found], pa.list_(span)) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "base", "spans"])

    kind = documents.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, base {spans}, spans {spans}")

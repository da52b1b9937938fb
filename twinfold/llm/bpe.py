"""Byte-level BPE by backtracking over longest matches.

An Aho-Corasick automaton finds all vocabulary tokens in a word. The encoder takes the longest
token at each place whose pair with the token before is compatible, that is, which merging by
rank would leave as they are; where none is, it goes back to a shorter token. A sequence of
pairwise compatible tokens is unique, so the result equals merging pair by pair, in linear
time. Decoding gathers bytes through a table of offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import WordTable, runs
from .workers import give_back, prepare, released, sliced

# The split into words of this family of vocabularies, and its printable letters for bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

MOST_CACHED = 250_000  # words a task remembers
MOST_PAIRS = 150_000
SLICE_ROWS, SLICE_BYTES = 500, 1_000_000  # documents whose ids and texts a worker holds at once
_STRETCH = 4096  # starting places whose matches are held at once


def _letters() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pairs(dict):
    """Whether two tokens may stand side by side, by left << 32 | right."""

    def __init__(self, compatible) -> None:
        super().__init__()
        self.compatible = compatible

    def __missing__(self, pair: int) -> bool:
        if len(self) >= MOST_PAIRS:
            self.clear()
        got = self[pair] = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        return got


class BacktrackingBpe:
    """Vocabulary, automaton and pair table of one tokenizer file (its JSON text): the encoder."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        letter = _letters()
        model = spec["model"]
        self.bytes_of = {i: bytes(letter[c] for c in token) for token, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        vocab = model["vocab"]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged.setdefault((a, b), (rank, c))
            self.parts.setdefault(c, (rank, a, b))
        self.longest = max(map(len, self.bytes_of.values()))
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if i in self.parts:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        # single bytes match everywhere; they are looked up where nothing longer is compatible
        self.single = {b.decode("latin-1"): (1, i) for b, i in self.id_of.items() if len(b) == 1}
        self.automaton.make_automaton()
        self.pairs = _Pairs(self._compatible)
        self.split = regex.compile(WORDS).findall
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special) or "(?!)")
        self.known = WordTable(MOST_CACHED)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` apart.

        The two are undone merge by merge, latest first. If, at some stage, the two tokens at the
        border form a pair that merges before what has been undone on either side was made,
        merging would have joined them. Equal ranks: the pair further left merges first.
        """
        # whatever was undone last must come after the border pair for it to be taken
        limit = (1 << 62, 0)
        while True:
            pair = self.merged.get((left, right))
            # the border pair stands right of pairs in the left token and left of those in the right one
            if pair and (pair[0], 1) < limit:
                return False
            rank_l = self.parts[left][0] if left in self.parts else -1
            rank_r = self.parts[right][0] if right in self.parts else -1
            if rank_l < 0 and rank_r < 0:
                return True
            if rank_l > rank_r:
                limit, left = (rank_l, 0), self.parts[left][2]
            else:
                limit, right = (rank_r, 2), self.parts[right][1]

    def matches(self, text: str, start: int, stop: int) -> list[list[tuple[int, int]]]:
        """For each place from ``start`` to ``stop`` the tokens (length, id) that begin there,
        shortest first, as their ends come in ascending order."""
        found = [[self.single[c]] for c in text[start:stop]]
        for end, match in self.automaton.iter(text, start, min(len(text), stop + self.longest)):
            at = end + 1 - match[0]
            if at < stop:
                found[at - start].append(match)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one word, as merging by rank gives them."""
        text, size, pairs = word.decode("latin-1"), len(word), self.pairs
        found = self.matches(text, 0, size) if size <= _STRETCH else _Stretches(self, text)
        tokens: list[int] = []
        chosen: list[int] = []  # which of the matches at its place each token is
        dead: set[tuple[int, int]] = set()  # (place, token before) from which no way leads on
        at, before, k = 0, -1, -1
        while at < size:
            here = found[at]
            if k < 0:
                k = len(here)
            while k:
                k -= 1
                length, token = here[k]
                if (before < 0 or pairs[before << 32 | token]) and not (dead and (at + length, token) in dead):
                    tokens.append(token)
                    chosen.append(k)
                    at, before, k = at + length, token, -1
                    break
            else:
                if not tokens:
                    raise ValueError("no way through the word")
                dead.add((at, before))
                at -= len(self.bytes_of[tokens.pop()])
                k = chosen.pop()
                before = tokens[-1] if tokens else -1
        return tokens

    def _learn(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The ids of new words."""
        each = [self.encode_word(w.encode("utf-8", "replace")) for w in words]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return list(range(len(words))), np.fromiter((i for ids in each for i in ids), "<u4", int(sizes.sum())), sizes

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; special tokens in them count as such. Words
        of all texts are made distinct, and the ids of each are dealt to all its places."""
        parts: list[tuple[int, str | int]] = []  # (text, plain stretch or special id)
        for at, text in enumerate(texts):
            start = 0
            if any(s in text for s in self.special):
                for m in self.specials.finditer(text):
                    parts += [(at, text[start:m.start()]), (at, self.special[m.group()])]
                    start = m.end()
            parts.append((at, text[start:]))
        split = [self.split(x) if isinstance(x, str) else [] for _, x in parts]
        coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
        ids, begin, size = self.known.look_up(coded.dictionary, self._learn)
        place = coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(size[place]))
        data = ids[runs(begin[place], size[place])].tobytes()
        cuts = (4 * ends[np.append(0, np.cumsum([len(words) for words in split]))]).tolist()
        found: list[list[bytes]] = [[] for _ in texts]
        for (at, x), a, b in zip(parts, cuts[:-1], cuts[1:], strict=True):
            found[at].append(data[a:b] if isinstance(x, str) else np.array([x], dtype="<u4").tobytes())
        return [b"".join(pieces) for pieces in found]

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_texts([text])[0]


class OffsetDecoder:
    """The bytes of all tokens in one run, and where each token's begin."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        letter = _letters()
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"] if t["special"]}
        token_of = {i: t for t, i in spec["model"]["vocab"].items()}
        size = max([*token_of, *special]) + 1
        pieces = [special[i] if i in special else bytes(letter[c] for c in token_of.get(i, "")) for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement signs."""
        numbers = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        begin = self.offsets[numbers]
        lengths = self.offsets[numbers + 1] - begin
        ends = np.cumsum(lengths)
        if not len(ends):
            return ""
        places = np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[places].tobytes().decode("utf-8", "replace")


class _Stretches:
    """The matches of a long word, stretch by stretch, of which the last few are held."""

    def __init__(self, coder: BacktrackingBpe, text: str) -> None:
        self.coder, self.text, self.held = coder, text, {}

    def __getitem__(self, at: int) -> list[tuple[int, int]]:
        number, place = divmod(at, _STRETCH)
        if number not in self.held:
            if len(self.held) > 2:
                self.held.pop(min(self.held))
            start = number * _STRETCH
            self.held[number] = self.coder.matches(self.text, start, min(len(self.text), start + _STRETCH))
        return self.held[number][place]


@lru_cache(maxsize=2)
def _loaded(kind: type, tokenizer_json: str) -> BacktrackingBpe | OffsetDecoder:
    made = kind(tokenizer_json)
    give_back()  # what reading the file took
    return made


def _mapped(df: DataFrame, columns: list[str], tokenizer_json: str, schema: str, make) -> DataFrame:
    prepare(df.sparkSession)
    content = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1, SLICE_ROWS, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *make(content.value, part)], names)

    names = [field.split(" ")[0] for field in schema.split(", ")]
    # the tables go with the task: a worker that waits for other stages should be small
    return df.select(*columns).mapInArrow(released(run, lambda: _loaded.cache_clear()), schema)


def _encoded(content: str, texts: pa.Array) -> list[bytes]:
    return _loaded(BacktrackingBpe, content).encode_texts([t or "" for t in texts.to_pylist()])


def _decoded(content: str, ids: list[bytes | None]) -> pa.Array:
    decode = _loaded(OffsetDecoder, content).decode
    return pa.array([decode(i or b"") for i in ids], pa.string())


def encode_documents(documents: DataFrame, id_col: str, text_col: str, tokenizer_json: str) -> DataFrame:
    """(id, ids): the token ids of every whole text as little-endian 32-bit integers.

    ``tokenizer_json`` is the content of a byte-level BPE file. Null texts count as empty and have
    no ids; rows are neither dropped nor merged, whatever their id; other columns are ignored.
    """
    def make(content: str, part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(_encoded(content, part.column(1)), pa.binary())]

    kind = documents.schema[id_col].dataType.simpleString()
    return _mapped(documents, [id_col, text_col], tokenizer_json, f"id {kind}, ids binary", make)


def decode_documents(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """(id, text) from the result of ``encode_documents``; null ids decode to an empty text."""
    def make(content: str, part: pa.RecordBatch) -> list[pa.Array]:
        return [_decoded(content, part.column(1).to_pylist())]

    kind = encoded.schema["id"].dataType.simpleString()
    return _mapped(encoded, ["id", "ids"], tokenizer_json, f"id {kind}, text string", make)


def encode_and_decode(documents: DataFrame, id_col: str, text_col: str, tokenizer_json: str) -> DataFrame:
    """(id, ids, text): both at once, in one pass of the documents through one Python worker per
    task; the same as ``decode_documents`` of ``encode_documents``."""
    def make(content: str, part: pa.RecordBatch) -> list[pa.Array]:
        ids = _encoded(content, part.column(1))
        return [pa.array(ids, pa.binary()), _decoded(content, ids)]

    kind = documents.schema[id_col].dataType.simpleString()
    return _mapped(documents, [id_col, text_col], tokenizer_json, f"id {kind}, ids binary, text string", make)

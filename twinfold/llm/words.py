"""A table of words and their token ids: columns rather than Python objects, so that many fit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 64  # letters of a word that is remembered


def runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... over ``sizes[i]`` numbers, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordTable:
    """Words with their ids one after the other. A table of over ``most`` words is cut to those that the last
    look-up met again."""

    def __init__(self, most: int) -> None:
        self.most = most
        self._keep(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _keep(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.words, self.sizes, self.ids = words, sizes, ids
        self.begin = np.cumsum(sizes) - sizes

    def look_up(self, words: pa.Array, learn: Callable[[list[str]], tuple[list[int], np.ndarray, np.ndarray]]) \
            -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size) of distinct words. ``learn`` gives, for words not met yet, an order and in it the
        ids of all and the number of each."""
        place = np.array(pc.fill_null(pc.index_in(words, self.words), -1))
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.ids, self.begin[place], self.sizes[place]
        order, more, fresh = learn(words.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        new = new[order]
        learnt = words.take(pa.array(new))
        again = np.unique(place[place >= 0])
        ids, sizes = np.concatenate([self.ids, more]), np.append(self.sizes, fresh)
        begin = np.cumsum(sizes) - sizes
        place[new] = len(self.sizes) + np.arange(len(new))
        short = np.flatnonzero(pc.less_equal(pc.utf8_length(learnt), LONGEST).to_numpy(zero_copy_only=False))
        kept = again if len(sizes) > self.most else np.arange(len(self.sizes))
        stay = np.append(kept, len(self.sizes) + short)
        table = pa.concat_arrays([self.words.take(pa.array(kept)), learnt.take(pa.array(short))])
        self._keep(table, sizes[stay], ids[runs(begin[stay], sizes[stay])])
        return ids, begin[place], sizes[place]

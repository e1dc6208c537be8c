"""Arrays of words in Arrow batches: words gathered by row, some at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task gathers at a time.
WORDS = 1 << 20


def sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose lists have ``most`` words together, or one row."""
    ends, at = np.cumsum(sizes(batch.column(column))), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def gathered(lists: pa.ListArray, kept=None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(rows, words, starts, places) of each distinct word of each list, by word and then by row.

    The places of the n-th are ``places[starts[n]:starts[n + 1]]``, counted among the words that
    are kept; ``kept`` says of an array of distinct words which those are.
    """
    n = max(len(lists), 1)
    row = np.repeat(np.arange(len(lists)), sizes(lists))
    coded = lists.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if kept is not None and len(word):
        here = np.asarray(kept(coded.dictionary))[word]
        row, word = row[here], word[here]
    first = np.r_[0, np.cumsum(np.bincount(row, minlength=n))[:-1]]
    place = np.arange(len(row)) - first[row]
    key = word * n + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[starts] % n, coded.dictionary.take(pa.array(key[starts] // n)), np.r_[starts, len(key)], place[order]

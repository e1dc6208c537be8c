"""Texts of a batch as words and codes: what is computed for a word is computed once a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task takes at a time; longer texts come alone.
BATCH_BYTES = 16 << 20


def batched(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, at least one row each; null texts become empty."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        full = pc.fill_null(batch.column(at), "")
        batch = batch.set_column(at, text, full)
        ends = np.cumsum(pc.binary_length(full).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= most or start < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word, offsets of each text's words); words are what stands between spaces."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.r_[0, np.cumsum(counts)]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(concatenation of flat[starts[c] : starts[c] + lengths[c]] for all codes, end of each)."""
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


#: What a byte of UTF-8 is to ``runs``: part of a word, space between words, or the end of a piece.
WORD, SPACE, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def kinds(space: bytes, ends: bytes = b"") -> np.ndarray:
    """The kind of each byte: those of ``space`` part words, those of ``ends`` part pieces too, all others are words."""
    table = np.zeros(256, np.uint8)
    table[list(space)] = SPACE
    table[list(ends)] = BREAK
    return table


#: Words of letters, digits and all characters beyond ASCII.
PLAIN = kinds(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))


def runs(texts: pa.Array, table: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words with A-Z in lower case, first word of each text and the end, piece ends before each word).

    Words are the longest runs of bytes of that kind within a text; a text of this batch never
    runs into the next one. Nulls must have been filled.
    """
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = (np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8))[at[0] : at[-1]]
    at = (at - at[0]).astype(np.int64)
    kind = table[raw]
    inside = kind == WORD
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    del first, last
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]]))
    broken = np.cumsum(kind == BREAK, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    return words.dictionary_encode(), np.searchsorted(starts, at), broken

"""Token counts by a count-only Viterbi search over a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import pick
from foliant.llm.pieces import NORMAL, SPACE, USER_DEFINED, PieceModel
from foliant.llm.spm import Normaliser
from foliant.llm.words import batched, split

#: Fixed value: how far an unknown character's score lies below the least piece's.
UNKNOWN_PENALTY = 10.0


class Counter(dict):
    """Pieces of the best segmentation of a marked word, computed when first asked for.

    An Aho-Corasick automaton enumerates the vocabulary's matches by their end, the longest
    first. For each end the search carries the best score and its number of pieces; a match
    replaces what is there only if its score is greater, so of equal scores the one with the
    longest last piece stays. A character that is no piece itself is unknown and stands alone;
    with byte fallback it counts as its UTF-8 bytes, without it a run of them is one token. Scores add up in double precision, so
    whole scores are exact in texts of any length, and a text's best segmentation is that of
    its words as long as no piece has a space mark after another character, which the
    constructor checks. Models with pieces that are matched before all others are refused.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.model = m = PieceModel.read(path)
        self.normaliser = Normaliser(m)
        if not m.escape_whitespaces or USER_DEFINED in m.types:
            raise ValueError("models that keep spaces or match some pieces before all others are not supported")
        self.most = most
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        scores = [s for s, t in zip(m.scores, m.types) if t == NORMAL]
        self.unknown = min(scores) - UNKNOWN_PENALTY
        for p, s, t in zip(m.pieces, m.scores, m.types):
            if t == NORMAL:
                if SPACE in p.lstrip(SPACE):
                    raise ValueError("pieces that cross words are not supported")
                self.automaton.add_word(p, (len(p), s))
                if len(p) == 1:
                    self.single.add(p)
        if not m.byte_fallback and SPACE not in self.single:
            raise ValueError("without byte fallback the space mark must be a piece")
        self.automaton.make_automaton()

    def search(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a normalised text."""
        n, low = len(text), float("-inf")
        best, count = [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        unknown = [False] * (n + 1)  # whether the best search ends with an unknown character
        strange = [i for i, c in enumerate(text) if c not in self.single]

        def alone(i: int) -> None:
            if best[i] + self.unknown > best[i + 1]:
                best[i + 1] = best[i] + self.unknown
                count[i + 1] = count[i] + (len(text[i].encode("utf-8")) if self.model.byte_fallback else not unknown[i])
                unknown[i + 1] = True

        at = 0
        for end, (length, score) in self.automaton.iter(text):
            while at < len(strange) and strange[at] < end:  # ends before this one are settled
                alone(strange[at])
                at += 1
            end += 1
            score += best[end - length]
            if score > best[end]:
                best[end] = score
                count[end] = count[end - length] + 1
                unknown[end] = False
        for i in strange[at:]:
            alone(i)
        return count[n], best[n]

    def __missing__(self, word: str) -> int:
        n = self.search(word)[0]
        if len(self) < self.most:
            self[word] = n
        return n

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; runs of spaces stay with the word after them.

        Where the model does more than mark spaces, each text is normalised by itself.
        """
        if not self.normaliser.plain or not self.model.add_dummy_prefix:
            return np.fromiter((self.units(self.normaliser.aligned(t)[0]) for t in texts.to_pylist()), np.int64, len(texts))
        counts = np.zeros(len(texts), np.int64)
        words, codes, offsets = split(texts)
        known = np.fromiter((self[SPACE + w.replace(" ", SPACE)] if SPACE not in w else -1 for w in words), np.int64, len(words))
        each = known[codes]
        blank = np.array([not w for w in words], bool)[codes] if words else np.zeros(0, bool)
        sums = np.r_[0, np.cumsum(each)][offsets]
        counts[:] = np.diff(sums)
        odd = np.diff(np.r_[0, np.cumsum(blank | (each < 0))][offsets]) > 0
        for k in np.flatnonzero(odd).tolist():
            text = texts[k].as_py()
            counts[k] = self.whole(text)
        return counts

    def whole(self, text: str) -> int:
        """Tokens of a text with runs of spaces or marks of its own."""
        if not text:
            return 0
        return self.units(SPACE + text.replace(" ", SPACE))

    def units(self, marked: str) -> int:
        """Tokens of a normalised text, which is cut before each run of space marks."""
        starts = [i for i in range(1, len(marked)) if marked[i] == SPACE and marked[i - 1] != SPACE]
        return sum(self[marked[a:b]] for a, b in zip([0, *starts], [*starts, len(marked)]))


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row: tokens of the whole text in its best unigram segmentation.

    Null and empty texts have none. Repeated rows are counted each; other columns are not read
    and may have any name. The model's character map and white-space rules are applied.
    """
    own = pick(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = Counter(model)
        for some in batched(batches):
            n = _counters[model].batch(some.column("text"))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n)], names=["doc_id", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long")

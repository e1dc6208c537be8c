"""Offset-preserving SentencePiece BPE: every piece keeps its span of the original bytes."""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pick
from foliant.llm.pieces import NORMAL, SPACE, UNUSED, USER_DEFINED, PieceModel
from foliant.llm.words import batched, gather, split


class CharacterMap:
    """The compiled character map: a double-array trie of prefixes and the strings that replace them."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.strings = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest prefix of ``data[at:]`` in the map."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = self._offset(unit)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Normaliser:
    """Rewrites a text and tells for each of its new bytes which original byte it came from."""

    def __init__(self, model: PieceModel):
        self.model, self.map = model, CharacterMap(model.charsmap)
        self.space = SPACE if model.escape_whitespaces else " "
        #: Whether white space is all that changes, one character for one.
        self.plain = not model.charsmap and not model.remove_extra_whitespaces and not model.whitespace_suffix

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for its n bytes, n + 1 original byte offsets."""
        m, data, space = self.model, text.encode("utf-8"), self.space.encode()
        chunks: list[tuple[bytes, int, int]] = []  # replacement, original offset, bytes consumed
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = n, data[at : at + n]
            chunks.append((found[1], at, found[0]))
            at += found[0]
        if m.remove_extra_whitespaces:
            while chunks and chunks[0][0] == b" ":
                chunks.pop(0)
        out, origin = bytearray(), []
        if not chunks:
            return "", np.array([len(data) if m.remove_extra_whitespaces else 0])

        def put(piece: bytes, place: int) -> None:
            out.extend(piece)
            origin.extend([place] * len(piece))

        if m.add_dummy_prefix and not m.whitespace_suffix:
            put(space, chunks[0][1])
        blank, end = m.remove_extra_whitespaces, chunks[0][1]
        for piece, place, consumed in chunks:
            if blank:
                piece = piece.lstrip(b" ")
            for b in piece:
                put(space if b == 32 else bytes([b]), place)
            if piece:
                blank = m.remove_extra_whitespaces and piece.endswith(b" ")
            end = place + consumed
        if m.remove_extra_whitespaces:
            while out.endswith(space):
                end = origin[len(out) - len(space)]
                del out[len(out) - len(space) :], origin[len(origin) - len(space) :]
        if m.add_dummy_prefix and m.whitespace_suffix:
            put(space, end)
        return out.decode("utf-8"), np.array([*origin, end])


#: A rank beyond all pieces'.
NONE = float("inf")


class Encoder(dict):
    """Piece ids (little-endian 32-bit bytes) of segments of a normalised text, computed when first asked for.

    A segment is a run of space marks with the characters after it; it is a unit if no piece
    has a space mark after another character, which the constructor checks. At most ``most``
    segments are held; others are computed each time.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.model = m = PieceModel.read(path)
        self.normaliser = Normaliser(m)
        self.most = most
        kinds = list(zip(m.pieces, m.scores, m.types))
        self.rank = {p: -s for p, s, t in kinds if t == NORMAL}
        self.id = {p: i for i, (p, _, t) in enumerate(kinds) if t == NORMAL}
        self.bytes = m.byte_ids()
        if any(t in (USER_DEFINED, UNUSED) for _, _, t in kinds) or any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces that cross words, are user-defined or are unused are not supported")
        if not m.byte_fallback:  # an unknown run would be one piece of any length
            raise ValueError("models without byte fallback are not supported")
        value = {i: bytes([b]) for b, i in self.bytes.items()}
        text = [p.replace(SPACE, " ").encode() if t == NORMAL else value.get(i, b"") for i, (p, _, t) in enumerate(kinds)]
        text[m.unknown] = " \u2047 ".encode()
        #: What each id decodes to, how many bytes it has in a normalised text, and in the text before.
        self.text = text
        self.normal_bytes = np.array([1 if i in value else len(p.encode()) for i, (p, _, _) in enumerate(kinds)])
        self.plain_bytes = self.normal_bytes - [2 * p.count(SPACE) if i not in value else 0 for i, p in enumerate(m.pieces)]
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, segment: str) -> list[str]:
        """Pieces of a segment: of all neighbours that form a piece the one of best score merges,
        of equal ones the leftmost, until none is left."""
        rank, parts = self.rank.get, list(segment)
        scores = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best is NONE:
                break
            at = scores.index(best)
            joined = parts[at] + parts.pop(at + 1)
            parts[at] = joined
            del scores[at]
            if at < len(scores):
                scores[at] = rank(joined + parts[at + 1], NONE)
            if at:
                scores[at - 1] = rank(parts[at - 1] + joined, NONE)
        return parts

    def long_merge(self, segment: str) -> list[str]:
        """``merge`` for long segments, with a heap in place of the scan."""
        rank, parts = self.rank, list(segment)
        n = len(parts)
        after, prior = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            joined = parts[a] + parts[b]
            if joined in rank:
                heapq.heappush(heap, (rank[joined], a, b, joined))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not parts[a] or not parts[b] or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, ""
            after[a] = after[b]
            if after[b] >= 0:
                prior[after[b]] = a
                offer(a, after[b])
            if prior[a] >= 0:
                offer(prior[a], a)
        return [p for p in parts if p]

    def __missing__(self, segment: str) -> bytes:
        ids: list[int] = []
        for part in self.merge(segment) if len(segment) < 48 else self.long_merge(segment):
            known = self.id.get(part)
            if known is not None:
                ids.append(known)
            else:
                ids += [self.bytes[b] for b in part.encode("utf-8")]
        value = array("i", ids).tobytes()
        if len(self) < self.most:
            self[segment] = value
        return value

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of one text: piece k covers the original bytes bounds[k] to bounds[k + 1]."""
        normal, origin = self.normaliser.aligned(text)
        ids = np.frombuffer(b"".join(map(self.__getitem__, self.segments.findall(normal))), np.int32)
        if not len(ids):
            return ids, np.zeros(1, np.int32)
        sizes = self.normal_bytes[ids]
        return ids, origin[np.r_[0, np.cumsum(sizes)]].astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids that ``encode`` gave, in UTF-8."""
        text = b"".join(map(self.text.__getitem__, ids))
        return text[1:] if self.model.add_dummy_prefix and text.startswith(b" ") else text

    def batch(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, bounds) of each text.

        Where the normaliser only marks spaces, which stand singly, the distinct words of all
        these texts are encoded once; other texts are normalised and aligned one by one.
        """
        if self.normaliser.plain:
            odd = pc.match_substring_regex(texts, f"^ |  |{SPACE}").to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(texts), bool)
        odd = odd | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        ids: list = [None] * len(texts)
        bounds: list = [None] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            ids[k], bounds[k] = self.encode(texts[k].as_py())
        words, codes, offsets = split(texts.filter(pa.array(~odd)))
        if len(words):
            coded = [self[SPACE + w] for w in words]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            flat = np.frombuffer(b"".join(coded), np.int32)
            flat, ends = gather(flat, np.cumsum(sizes) - sizes, sizes, codes)
            cuts = np.r_[0, ends][offsets].tolist()
            for n, k in enumerate(np.flatnonzero(~odd).tolist()):
                ids[k] = own = flat[cuts[n] : cuts[n + 1]]
                # the space mark before the first word stands for no byte of the text
                bounds[k] = np.maximum(np.r_[0, np.cumsum(self.plain_bytes[own]) - 1], 0).astype(np.int32)
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns per row: doc_id, ids (array of int), bounds (array of int: piece k covers the
    original bytes bounds[k] to bounds[k + 1]) and decoded (the text that the ids decode to).
    Null and empty texts have no ids, bounds [0] and an empty decoded text. Repeated rows are
    encoded each; other columns are not read and may have any name.
    """
    own = pick(docs, doc_id=doc_id, text=text)

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _encoders:
            _encoders[model] = Encoder(model)
        enc = _encoders[model]
        for some in batched(batches):
            ids, bounds = enc.batch(some.column("text"))
            for at in range(0, some.num_rows, 256):
                own = ids[at : at + 256]
                decoded = [enc.decode(i.tolist()).decode("utf-8") for i in own]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").slice(at, 256), lists(own), lists(bounds[at : at + 256]), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "bounds", "decoded"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, ids array<int>, bounds array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns of ``encode``, and the original bytes that the pieces cover."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.element_at("bounds", -1).cast("long").alias("n_bytes"),
    )

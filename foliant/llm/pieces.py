"""SentencePiece model files, read from their protobuf wire format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Piece types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    """Pieces with scores and types, and how the model wants its text normalised."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    byte_fallback: bool = False
    whitespace_suffix: bool = False

    @classmethod
    def read(cls, path: str) -> PieceModel:
        model = cls()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                got = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                model.pieces.append(got[1].decode("utf-8"))
                model.scores.append(struct.unpack("<f", got[2])[0])
                model.types.append(got[3])
            elif number == 2:
                got = dict(_fields(value))
                model.byte_fallback = bool(got.get(35, 0))
                model.whitespace_suffix = bool(got.get(24, 0))
            elif number == 3:
                got = dict(_fields(value))
                model.charsmap = got.get(2, b"")
                model.add_dummy_prefix = bool(got.get(3, 1))
                model.remove_extra_whitespaces = bool(got.get(4, 1))
                model.escape_whitespaces = bool(got.get(5, 1))
        return model

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}

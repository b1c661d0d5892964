"""Texts cut into chunks that a pre-tokenizer keeps apart, each distinct chunk encoded once.

A cut lies only where the patterns used here always begin a new piece, so the chunks between the cuts can be
encoded one by one and remembered. Chunks are stretches of the texts' own Arrow buffer: Arrow numbers the
distinct ones and puts the ids of all together again, and only distinct chunks that are new become Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are cut together; a longer text is a group of its own.
GROUP_BYTES = 4 << 20

# Kinds of bytes. UNSURE may be white space to one pattern engine and not to another.
UNSURE, SPACE, WHITE, SOLID, MARK, LETTER, LATIN, TWO, THREE = range(9)
KINDS = np.full(256, SOLID, np.uint8)
KINDS[[*range(32), 127]] = UNSURE
KINDS[9:14], KINDS[32] = WHITE, SPACE
for _code in range(33, 127):
    KINDS[_code] = LETTER if chr(_code).isalpha() else SOLID if chr(_code).isdigit() else MARK
#: First bytes of two that are a letter but for two signs, and first bytes of what may be white space.
KINDS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = LATIN
KINDS[0xC2], KINDS[0xE1:0xE4] = TWO, THREE
_SIGNS = [0xC397, 0xC3B7]
_BLANKS = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000)]


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """Every byte has the kind of its character."""
    kinds = KINDS[data]
    at = np.flatnonzero(kinds == LATIN)
    kind = np.where(np.isin(data[at].astype(np.int32) << 8 | data[at + 1], _SIGNS), SOLID, LETTER)
    kinds[at] = kinds[at + 1] = kind
    for first, more in ((TWO, 1), (THREE, 2)):
        at = np.flatnonzero(kinds == first)
        code = data[at].astype(np.int32)
        for k in range(1, more + 1):
            code = code << 8 | data[at + k]
        kinds[at] = SOLID
        at = at[np.isin(code, _BLANKS)]
        for k in range(more + 1):
            kinds[at + k] = UNSURE
    return kinds


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece is sure to begin at each byte of some UTF-8 text, and at its end.

    White space after anything else begins a piece, and so does an ASCII mark after a letter. One white
    character other than a space is a piece of its own between two characters that are not white.
    """
    kinds = byte_kinds(data)
    out = np.zeros(len(data) + 1, bool)
    before, here = kinds[:-1], kinds[1:]
    solid = kinds >= SOLID
    # Spaces and white bytes are the two kinds behind UNSURE.
    out[1:-1] = solid[:-1] & (here - SPACE < 2) | (before == LETTER) & (here == MARK)
    alone = np.flatnonzero(kinds[1:-1] == WHITE) + 1
    out[alone[solid[alone - 1] & solid[alone + 1]] + 1] = True
    return out


class ChunkEncoder:
    """Token ids of texts by their distinct chunks.

    ``encode_all`` gives the packed ids (little-endian, 32 bits) of each of some chunks. Chunks of up to
    ``longest`` bytes are remembered: those of the present generation and of the one before, up to ``limit``
    in both. Texts that hold one of ``literals`` are one chunk. Results depend on none of this.
    """

    def __init__(
        self, encode_all: Callable[[list[str]], list[bytes]], literals: list[str] = (), limit: int = 600_000, longest: int = 64,
        group_bytes: int = GROUP_BYTES,
    ):
        self.encode_all, self.literals, self.limit, self.longest, self.group_bytes = encode_all, literals, limit, longest, group_bytes
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _packed(self, chunks: list[bytes]) -> list[bytes]:
        out = list(map(self.young.get, chunks))
        new = []
        for i, ids in enumerate(out):
            if ids is None:
                if (ids := self.old.get(chunks[i])) is None:
                    new.append(i)
                else:
                    out[i] = self.young[chunks[i]] = ids
        for i, ids in zip(new, self.encode_all([chunks[i].decode() for i in new])):
            out[i] = ids
            if len(chunks[i]) <= self.longest:
                self.young[chunks[i]] = ids
        if len(self.young) > self.limit // 2:
            self.old, self.young = self.young, {}
        return out

    def _group(self, texts: pa.Array, bounds: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
        begins = cuts(data)
        for literal in self.literals:
            for row in np.flatnonzero(pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)):
                begins[bounds[row] : bounds[row + 1]] = False
        begins[bounds] = True
        at = np.flatnonzero(begins)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        ids = pa.array(self._packed(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(at)] // 4
        flat = np.frombuffer(ids.buffers()[2], "<u4")
        at = ends[np.searchsorted(at, bounds)].tolist()
        return (flat[a:b] for a, b in zip(at, at[1:]))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + self.group_bytes, "right")) - 1)
            size = int(bounds[stop] - bounds[row])
            if size:
                data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(bounds[row]))
                yield from self._group(texts[row:stop], bounds[row : stop + 1] - bounds[row], data)
            else:
                yield from [np.zeros(0, "<u4")] * (stop - row)
            row = stop


def pack_each(lists: list[list[int]]) -> list[bytes]:
    data = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
    return [data[a:b] for a, b in pairwise(accumulate((4 * len(ids) for ids in lists), initial=0))]


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")

"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last one of its encoding. The table of
these last tokens gives the encoding of every prefix; it grows by one entry per appended byte, and
after an edit it is rebuilt only from the edit to where it falls in step with the old table again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rillbook.llm.chunks import ChunkEncoder, pack_each, unpack


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        #: Tokens read from their last byte: byte -> (what goes on before it, token or -1). Looking back from a byte
        #: stops where no token can go on. A token that merging its own bytes does not give is never the last one.
        self.back: dict[int, list] = {}
        for t, i in ranks.items():
            inner = self.back
            for byte in reversed(t):
                step = inner.setdefault(byte, [{}, -1])
                inner = step[0]
            if self.halves(i) is not None:
                step[1] = i

    def merged(self, data: bytes) -> tuple[list[int], tuple[bytes, bytes] | None]:
        """Merge the pair of lowest rank, leftmost first, until none is left; also the last two parts merged.

        For the bytes of one token only.
        """
        parts, latest = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            _, i = min(found)
            latest = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts], latest

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; () for a byte, None if merging its bytes ends elsewhere."""
        if token not in self._halves:
            ids, latest = self.merged(self.bytes_of[token])
            self._halves[token] = None if ids != [token] else () if latest is None else tuple(map(self.ranks.get, latest))
        return self._halves[token]

    def together(self, pair: int) -> bool:
        """Does merging leave the border between two tokens alone? The pair is ``left << 32 | right``."""
        if len(self.pairs) > 300_000:
            self.pairs.clear()
        known = self.pairs[pair] = self._border_holds(pair >> 32, pair & 0xFFFFFFFF)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        """Undo the later merge of the two sides, again and again; the parts that meet at the border in between
        must not have been merged with each other before that."""
        before = len(self.bytes_of) << 8
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < before:
                return False
            left, right = self.halves(a), self.halves(b)
            if not left and not right:
                return True
            if left and (not right or a > b):
                before, a = a, left[1]
            else:
                # Of equal ranks the left pair goes first, and the border lies left of this merge.
                before, b = b + 1, right[0]


class PrefixTable:
    """The last token of every prefix of ``data``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, begin: int, stop: int) -> None:
        """Entries of the prefixes of ``begin + 1`` to ``stop`` bytes."""
        v, data, last = self.vocabulary, self.data, self.last
        back, pairs, holds, put = v.back, v.pairs, v.together, self.last.append
        for end in range(begin + 1, stop + 1):
            start, inner = end, back
            while start:
                start -= 1
                step = inner.get(data[start])
                if step is None:
                    raise ValueError(f"no token ends at byte {end}")
                inner, token = step
                if token >= 0:
                    if not start:
                        break
                    key = last[start] << 32 | token
                    if (known := pairs.get(key)) is None:
                        known = holds(key)
                    if known:
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")
            put(token)

    def append(self, more: bytes) -> PrefixTable:
        """Exact: entries of the old prefixes stay as they are."""
        begin = len(self.data)
        self.data += more
        self._fill(begin, len(self.data))
        return self

    def become(self, data: bytes) -> PrefixTable:
        """The table of other data: entries of the prefixes that both have stay as they are."""
        same = next((k for k, (a, b) in enumerate(zip(self.data, data)) if a != b), min(len(self.data), len(data)))
        self.data = data
        del self.last[same + 1 :]
        self._fill(same, len(data))
        return self

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; the number of entries that were built anew.

        An entry looks back over the longest token at most. Once so many entries in a row equal the old
        ones, all later ones do.
        """
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError("the edit lies outside the data")
        old_last, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same, end = old_last[: start + 1], 0, start
        while end < len(self.data):
            end += 1
            self._fill(end - 1, end)
            before = end - shift
            past = end > start + len(new)
            same = same + 1 if past and before > stop and old_last[before] == self.last[end] else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[before + 1 :]
                break
        return end - start

    def ids(self, end: int | None = None) -> list[int]:
        """Token ids of the prefix of ``end`` bytes."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


#: Workers outlive a stage, and other stages need the memory: a small memo, small groups.
MEMO, GROUP_BYTES = 60_000, 1 << 20


class Encoder:
    """Texts to ids: each match of the pattern by a table, whole-piece tokens as they are.

    New pieces come in order of their bytes, so that one table serves a piece after the other and only
    what is behind their common beginning is built.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.chunks = vocabulary, ChunkEncoder(self._chunks, limit=MEMO, group_bytes=GROUP_BYTES)
        self.spelled = pa.array([vocabulary.bytes_of.get(i) for i in range(max(vocabulary.bytes_of) + 1)], pa.large_binary())

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = []
        for chunk in chunks:
            # A word of plain letters is one piece.
            letters = chunk[1:] if chunk[:1] == " " else chunk
            parts.append((chunk,) if letters.isascii() and letters.isalpha() else self.vocabulary.pattern.findall(chunk))
        pieces = sorted(set().union(*parts))
        table, whole = PrefixTable(self.vocabulary), self.vocabulary.ranks.get
        found = ([i] if (i := whole(data)) is not None else table.become(data).ids() for data in map(str.encode, pieces))
        ids = dict(zip(pieces, pack_each(list(found))))
        return [ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> bytes:
        """Packed ids."""
        return next(self.chunks.encode(pa.array([text]))).tobytes()

    def decode(self, ids: bytes) -> bytes:
        found = self.spelled.take(pa.array(unpack(ids)))
        ends, data = found.buffers()[1:]
        return b"" if data is None else data.slice(0, struct.unpack_from("<q", ends, 8 * len(found))[0]).to_pybytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker; its memos serve all batches."""
    return Encoder(Vocabulary(read_ranks(path), pattern))


_RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row: number of ids, hashes of the ids and of the bytes decoded from them; the ids on request.

    A null text counts as empty: no ids, the hashes of nothing. Repeated rows give repeated results.
    """
    kinds = _RESULT + (", ids array<bigint>" if with_ids else "")

    def encode(texts: pa.Array) -> pa.Array:
        enc, rows = encoder(path, pattern), []
        for found in enc.chunks.encode(texts):
            ids = found.tobytes()
            row = (len(found), hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest())
            rows.append((*row, found.tolist()) if with_ids else row)
        columns = zip(*rows) if rows else [[] for _ in kinds.split(", ")]
        return pa.StructArray.from_arrays([*map(pa.array, columns, types)], [k.split()[0] for k in kinds.split(", ")])

    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())][: len(kinds.split(", "))]
    return docs.select("doc_id", F.arrow_udf(encode, kinds)(F.col("text")).alias("e")).select("doc_id", "e.*")

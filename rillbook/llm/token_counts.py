"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

Two transducers in a row. The splitter reads classes of characters and marks where pieces begin: it has
so few states that a chunk of text is a map from every state to the state after it. The maps of all chunks
compose in a parallel prefix scan, after which all chunks run at once from states they are known to start
in. Each piece then runs through the vocabulary's transducer (``automaton``), whose transitions carry the
numbers of tokens they add.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillbook.llm.automaton import PrefixAutomaton

#: A document with more tokens is over the limit.
LIMIT = 512
#: Characters of a chunk, and chunks whose maps are composed together.
CHUNK, CHUNKS = 64, 16_384
#: Characters of the texts that are split in one go; a longer text is a go of its own.
TEXTS = 2_000_000
#: Distinct pieces remembered by a worker, and the longest of them.
PIECES, LONGEST = 300_000, 48

# Classes of characters: letters by their part in the contractions 's 't 'm 'd 're 've 'll.
LETTER, ONE, R, V, L, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)
# States by the piece that is open: none, letters, numbers, others, one space, one other white space, longer
# white space by its last character, a quote, a quote with r, v or l.
NEW, LETTERS, NUMBERS, OTHERS, BLANK, GAP, BLANKS, GAPS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
#: A piece begins at this character, or one before it.
HERE, BEFORE = 1, 2


def _from_new(kind: int) -> int:
    if kind <= E:
        return LETTERS
    return {NUMBER: NUMBERS, SPACE: BLANK, WHITE: GAP, QUOTE: QUOTED, OTHER: OTHERS, END: NEW}[kind]


def _after_blank(kind: int) -> int:
    """One space goes with what follows, a quote included."""
    return LETTERS if kind <= E else NUMBERS if kind == NUMBER else OTHERS


def transition(state: int, kind: int) -> tuple[int, int]:
    """(state, marks) of the splitter: where pieces begin, as far as this character decides it."""
    white, letter = kind in (SPACE, WHITE), kind <= E
    if kind == END:
        return NEW, HERE | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    if state in (BLANK, GAP, BLANKS, GAPS):
        if white:
            return (BLANKS if kind == SPACE else GAPS), 0
        if state == BLANK:
            return _after_blank(kind), 0
        if state == BLANKS:
            return _after_blank(kind), BEFORE
        return _from_new(kind), HERE | (BEFORE if state == GAPS else 0)
    if state == QUOTED:
        if kind == ONE:
            return NEW, 0
        if kind in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
        if kind in (QUOTE, OTHER):
            return OTHERS, 0
        return _from_new(kind), HERE
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L if state == QUOTED_L else E):
            return NEW, 0
        # The quote stands alone, and the letter began a piece.
        return (LETTERS, BEFORE) if letter else (_from_new(kind), HERE | BEFORE)
    goes_on = state == LETTERS and letter or state == NUMBERS and kind == NUMBER or state == OTHERS and kind in (QUOTE, OTHER)
    return (state, 0) if goes_on else (_from_new(kind), HERE)


STATES = KINDS = 12
_TABLE = [transition(s, k) for s in range(STATES) for k in range(KINDS)]
#: Next state and marks by ``state * KINDS + kind``; the first one already multiplied by KINDS.
NEXT = np.array([s * KINDS for s, _ in _TABLE], np.uint8)
MARKS = np.array([m for _, m in _TABLE], np.uint8)


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of maps (chunk, state) -> state, by doubling distances."""
    maps, far = maps.copy(), 1
    while far < len(maps):
        maps[far:] = np.take_along_axis(maps[far:], maps[:-far].astype(np.intp), 1)
        far *= 2
    return maps


def piece_starts(kinds: np.ndarray, chunk: int = CHUNK, chunks: int = CHUNKS) -> np.ndarray:
    """Positions where pieces begin in characters of these classes."""
    marks, state = np.zeros(len(kinds) + 1, np.uint8), NEW
    for at in range(0, len(kinds), chunk * chunks):
        part = kinds[at : at + chunk * chunks]
        rows = -(-len(part) // chunk)
        padded = np.full(rows * chunk, END, np.uint8)
        padded[: len(part)] = part
        # Column by column, so that every step reads one stretch of memory.
        columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
        maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8) * KINDS, (rows, STATES)).copy()
        for column in columns:
            maps += column[:, None]
            maps = NEXT[maps]
        after = composed(maps // KINDS)
        now = np.empty(rows, np.uint8)
        now[0], now[1:] = state, after[:-1, state]
        out = np.empty_like(columns)
        now *= KINDS
        for column, mark in zip(columns, out):
            now += column
            mark[:] = MARKS[now]
            now = NEXT[now]
        marks[at : at + len(part)] = out.T.reshape(-1)[: len(part)]
        state = int(after[-1, state])
        if len(part) < rows * chunk:
            # The padding ended the last piece too early: only possible in the last round.
            break
    begins = marks[:-1] & HERE
    begins |= (marks[1:] & BEFORE) >> 1
    return np.flatnonzero(begins)


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class MergeList:
    """The vocabulary of a list of merges: bytes are 0 to 255, the token of merge ``k`` is ``256 + k``."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in number:
                raise ValueError("two merges give one token")
            pair = number[a], number[b]
            number[a + b] = self.pairs[pair] = len(self.halves)
            self.halves.append(pair)
        self.spelled = list(number)

    def merged(self, data: bytes) -> list[int]:
        """Lowest merge first, leftmost of equal ones, until none is left. For the bytes of one token only."""
        parts = list(data)
        while len(parts) > 1:
            found = [(m, i) for i, pair in enumerate(zip(parts, parts[1:])) if (m := self.pairs.get(pair)) is not None]
            if not found:
                break
            token, i = min(found)
            parts[i : i + 2] = [token]
        return parts

    def together(self, left: int, right: int) -> bool:
        """Undo the later merge on either side of the border, again and again: the parts that meet at the border
        must not have been merged with each other before that."""
        before = len(self.halves)
        while True:
            if self.pairs.get((left, right), before) < before:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                before, left = left, self.halves[left][1]
            else:
                # Of equal merges the left one goes first, and the border lies left of this one.
                before, right = right + 1, self.halves[right][0]

    def automaton(self) -> PrefixAutomaton:
        whole = ((i, data) for i, data in enumerate(self.spelled) if i < 256 or self.merged(data) == [i])
        return PrefixAutomaton(whole, self.together)


class Counter:
    """Counts of one tokenizer file of the ``tokenizers`` library: byte-level BPE split by its built-in pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        bytes_only = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = told.get("added_tokens", [])
        simple = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model.get("type") != "BPE" or not plain or not bytes_only or told.get("normalizer") or not simple:
            raise ValueError("only byte-level BPE without normaliser, prefixes and suffixes can be compiled")
        byte = _alphabet()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.automaton = MergeList([tuple(bytes(map(byte.__getitem__, part)) for part in pair) for pair in pairs]).automaton()
        literals = sorted((t["content"] for t in added), key=len, reverse=True)
        self.literal = re.compile("|".join(map(re.escape, literals))) if literals else None
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.kinds = np.full(0x110000, 255, np.uint8)
        for kind, chars in ((ONE, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (SPACE, " "), (QUOTE, "'")):
            self.kinds[list(map(ord, chars))] = kind
        self.pieces: dict[str, int] = {}

    def _kind(self, char: str) -> int:
        """The library's own tables decide, as versions of Unicode differ: what does the character go with?"""
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.split(before + char)) == 1:
                return kind
        return WHITE

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kinds[codes]
        if (new := kinds == 255).any():
            for code in np.unique(codes[new]).tolist():
                self.kinds[code] = self._kind(chr(code))
            kinds = self.kinds[codes]
        return kinds

    def _counted(self, pieces: list[str]) -> list[int]:
        known, count = self.pieces, self.automaton.count
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > PIECES:
            known.clear()
        out = []
        for piece in pieces:
            if (n := known.get(piece)) is None:
                n = count(piece.encode())
                if len(piece) <= LONGEST:
                    known[piece] = n
            out.append(n)
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Numbers of tokens of some texts, split in one go."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            some = self.literal.split(text) if self.literal else [text]
            out[i] += len(some) - 1
            parts += some
            owner += [i] * len(some)
        joined = "\n".join(parts) + "\n"
        kinds = self.classes(joined)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        kinds[ends] = END
        starts = piece_starts(kinds)
        # A part's pieces lie before its end mark; the mark is a piece that does not count.
        marks = np.searchsorted(starts, ends)
        at = [*starts.tolist(), len(joined)]
        begun = 0
        for i, mark in zip(owner, marks.tolist()):
            for low in range(begun, mark, 100_000):
                some = at[low : min(low + 100_000, mark) + 1]
                out[i] += sum(self._counted([joined[a:b] for a, b in zip(some, some[1:])]))
            begun = mark + 1
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > TEXTS:
                out.append(self.counts(group))
                group, size = [], 0
            group.append(text)
            size += len(text)
        return np.concatenate([*out, self.counts(group)]) if group else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker; its transducer and memo serve all batches."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, from its whole text.

    Literals of added tokens are one token each, as the library has it. A null text counts as empty: no
    bytes, no tokens. Repeated rows and null ids give a row each; an empty table gives none.
    """

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path)(texts.tolist()))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.pandas_udf(count, "bigint")(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

"""Collocations of two to four words, counted exactly in tiles of word pairs.

Texts become chunks of word numbers. Frequent words are numbered anew by falling frequency, so a pair of
numbers is an address in a plane whose corner is crowded. The plane is cut into square tiles: a tile that is
well filled is counted densely by ``bincount``, the sparse rest as sorted addresses with counts. Counts of
one chunk are added up over all chunks per bucket of tiles. The frequent pairs are numbered again, the most
frequent of a bucket first, and count as the words of the next plane: pairs of adjacent pairs are phrases of
three words, pairs of pairs two words apart phrases of four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from rillbook.llm.common import shuffles, stored

#: Least occurrences of a phrase; part of a longer phrase's occurrences, in hundredths, that drops a shorter one; rows a language.
LEAST, COVERED, TOP = 30, 80, 2000
#: Words in a chunk of one language; a longer document is a chunk of its own.
CHUNK = 2_000_000
#: Side of a tile as a power of two; side of the corner, in tiles, where dense tiles are looked for; filling that makes one dense.
SIDE, CORNER, FILLING = 8, 32, 0.5
AREA = 1 << 2 * SIDE
#: What ends a piece; white space inside one.
ENDS, BREAK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_SPLIT = bytes(BREAK[0] if b in ENDS else b for b in range(256))


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a, "<i8").tobytes() for a in arrays), 1)


def _unpacked(blob: bytes, arrays: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "<i8").reshape(arrays, -1)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Chunk:
    """Word numbers of texts of one language, in order of first use; number 0 ends a piece."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers({BREAK: 0}), [np.zeros(1, np.int32)], 0

    def add(self, text: bytes) -> None:
        words = text.lower().translate(_SPLIT).replace(BREAK, b" \xff ").split()
        self.parts += [np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.size += len(words)

    def row(self, chunk: int, lang: str) -> dict:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.numbers))
        # Runs of piece ends say no more than one.
        ids = ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))]
        return {"chunk": chunk, "lang": lang, "words": list(self.numbers)[1:], "counts": counts[1:], "ids": zstandard.compress(ids.astype("<i4").tobytes(), 1)}


_CHUNKS = "chunk bigint, lang string, words array<binary>, counts array<bigint>, ids binary"


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Texts as chunks of word numbers with the words and their counts."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, _Chunk] = {}
        base, done = TaskContext.get().partitionId() << 32, 0

        def close(lang: str) -> pd.DataFrame:
            nonlocal done
            done += 1
            return pd.DataFrame([open_.pop(lang).row(base + done, lang)])

        for batch in batches:
            for lang, text in zip(batch.lang, batch.text):
                held = open_.setdefault(lang, _Chunk())
                held.add(text)
                if held.size >= size:
                    yield close(lang)
                while sum(c.size for c in open_.values()) >= 2 * size:
                    yield close(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            yield close(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return stored(rows.mapInPandas(chunks, _CHUNKS), "phrase-chunks")


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (lang, word, f) with ``id``: 0, 1, 2, ... by falling frequency in each language.

    Sorted by ranges; one row per language and range says where its numbers start.
    """
    order = [F.col("lang"), F.col("f").desc(), F.col("word")]
    ranged = words.repartitionByRange(shuffles(words), *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "phrase-words").withColumn("part", F.shiftright("at", 33))
    starts = placed.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("lang", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # At most one row per range and language.
    return placed.join(F.broadcast(starts), ["lang", "part"]).select("lang", "word", "f", (F.col("at") + F.col("shift")).alias("id"))


def address(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tile and place in it as one sortable number."""
    side, low = np.int64(SIDE), np.int64((1 << SIDE) - 1)
    if len(left) and max(int(left.max()), int(right.max())) >> 31:
        raise ValueError("more than 2^31 words or pairs of one language")
    return (left >> side) << 40 | (right >> side) << 16 | (left & low) << side | right & low


def _left(code: str) -> str:
    return f"(shiftright({code}, 40) << {SIDE} | (shiftright({code}, {SIDE}) & {(1 << SIDE) - 1}))"


def _right(code: str) -> str:
    return f"((shiftright({code}, 16) & {(1 << 24) - 1}) << {SIDE} | ({code} & {(1 << SIDE) - 1}))"


def tile_counts(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of distinct addresses, ascending; ``weights`` are counts to add up."""
    tile = codes >> 16
    row, column = tile >> 24, tile & ((1 << 24) - 1)
    corner = (row < CORNER) & (column < CORNER)
    place = (row[corner] * CORNER + column[corner]).astype(np.int64)
    filled = np.bincount(place, minlength=CORNER * CORNER)
    dense = np.flatnonzero(filled >= FILLING * AREA)
    found, counts = [], []
    if len(dense):
        number = np.full(CORNER * CORNER, -1)
        number[dense] = np.arange(len(dense))
        inside = np.flatnonzero(corner)
        which = number[place]
        inside, which = inside[which >= 0], which[which >= 0]
        exact = weights is None or int(weights.sum()) < 1 << 53
        flat = which * AREA + (codes[inside] & (AREA - 1))
        if weights is None:
            sums = np.bincount(flat, minlength=len(dense) * AREA)
        elif exact:
            sums = np.bincount(flat, weights[inside], len(dense) * AREA).astype(np.int64)
        else:
            sums = np.zeros(len(dense) * AREA, np.int64)
            np.add.at(sums, flat, weights[inside])
        at = np.flatnonzero(sums)
        tiles = dense[at // AREA]
        found.append((tiles // CORNER) << 40 | (tiles % CORNER) << 16 | at % AREA)
        counts.append(sums[at])
        rest = np.ones(len(codes), bool)
        rest[inside] = False
        codes, weights = codes[rest], None if weights is None else weights[rest]
    order = np.sort(codes) if weights is None else codes[o := np.argsort(codes)]
    first = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.zeros(0, np.int64)
    found.append(order[first])
    counts.append(np.diff(np.append(first, len(order))) if weights is None else np.add.reduceat(weights[o], first) if len(first) else first)
    codes, counts = np.concatenate(found), np.concatenate(counts)
    order = np.argsort(codes, kind="stable")
    return codes[order], counts[order].astype(np.int64)


def buckets_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """All addresses of one tile fall in one bucket."""
    mixed = (codes >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_PARTIAL = "chunk bigint, lang string, size int, bucket int, blob binary, seq binary"


def _partials(chunk: int, lang: str, size: int, codes: np.ndarray, buckets: int) -> list[tuple]:
    codes, counts = tile_counts(codes)
    where = buckets_of(codes, buckets)
    order = np.argsort(where, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(where[order])) + 1, len(order))
    out, at = [], 0
    for end in ends.tolist() if len(order) else ():
        part = order[at:end]
        out.append((chunk, lang, size, int(where[part[0]]), _packed(np.diff(codes[part], prepend=0), counts[part]), None))
        at = end
    return out


def _frame(rows: list[tuple], kinds: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[k.split()[0] for k in kinds.split(", ")])


def _pair_counter(buckets: int):
    """Chunks with the new numbers of their frequent words -> counts of pairs, and the chunk in new numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, lang, ids, at, new in zip(batch.chunk, batch.lang, batch.ids, batch["at"], batch.new):
                old = np.frombuffer(zstandard.decompress(ids), "<i4")
                number = np.full(int(old.max(initial=0)) + 1, -1, np.int64)
                number[np.asarray(at)] = new
                seq = number[old]
                # Infrequent words end phrases as piece ends do.
                seq = seq[np.append(True, (seq[1:] >= 0) | (seq[:-1] >= 0))]
                both = (seq[:-1] >= 0) & (seq[1:] >= 0)
                rows = _partials(chunk, lang, 2, address(seq[:-1][both], seq[1:][both]), buckets)
                yield _frame([*rows, (chunk, lang, 0, None, None, zstandard.compress(seq.astype("<i4").tobytes(), 1))], _PARTIAL)

    return count


def _longer_counter(buckets: int):
    """Chunks with the numbers of their frequent pairs -> counts of phrases of three and four words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, lang, packed, found in zip(batch.chunk, batch.lang, batch.seq, batch.found):
                seq = np.frombuffer(zstandard.decompress(packed), "<i4").astype(np.int64)
                known = np.concatenate([_unpacked(x, 2) for x in found], 1)
                codes, ids = known[:, np.argsort(known[0])]
                pair = np.full(max(len(seq) - 1, 0), -1, np.int64)
                both = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
                mine = address(seq[both], seq[both + 1])
                at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
                hit = codes[at] == mine
                pair[both[hit]] = ids[at[hit]]
                rows = []
                for size in (3, 4):
                    good = np.ones(max(len(pair) - size + 2, 0), bool)
                    for i in range(size - 1):
                        good &= pair[i : i + len(good)] >= 0
                    good = np.flatnonzero(good)
                    rows += _partials(chunk, lang, size, address(pair[good], pair[good + size - 2]), buckets)
                if rows:
                    yield _frame(rows, _PARTIAL)

    return count


_ADDED = "lang string, size int, bucket int, codes array<bigint>, counts array<bigint>, ids array<bigint>"


def _added(partials: DataFrame, buckets: int, least: int) -> DataFrame:
    """Counts of all chunks added up per bucket; codes with at least ``least``, numbered by falling count.

    A bucket's chunks stream by; what is held is the distinct addresses of one bucket.
    """

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def settle():
            nonlocal codes, counts, waiting, held
            new = np.concatenate([np.stack([codes, counts]), *waiting], 1)
            codes, counts = tile_counts(new[0], new[1])
            waiting, held = [], 0

        for batch in batches:
            for blob in batch.blob:
                part = _unpacked(blob, 2).copy()
                np.cumsum(part[0], out=part[0])
                waiting.append(part)
                held += part.shape[1]
                if held > max(len(codes), 500_000):
                    settle()
        settle()
        often = counts >= least
        codes, counts = codes[often], counts[often]
        ids = np.empty(len(codes), np.int64)
        ids[np.lexsort((codes, -counts))] = np.arange(len(codes)) * buckets + key[2]
        if len(codes):
            yield pd.DataFrame({"lang": [key[0]], "size": [key[1]], "bucket": [key[2]], "codes": [codes], "counts": [counts], "ids": [ids]})

    add.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    groups = partials.filter("size > 0").select("lang", "size", "bucket", "blob").groupBy("lang", "size", "bucket")
    return stored(groups.applyInPandas(add, _ADDED), "phrase-counts")


def _given_back(partials: DataFrame, frequent: DataFrame) -> DataFrame:
    """(chunk, found) where ``found`` packs codes and numbers of the frequent pairs of a chunk."""
    asked = partials.filter("size = 2").select("lang", "bucket", F.lit(1).alias("turn"), "chunk", "blob", *[F.lit(None).cast("array<bigint>").alias(c) for c in ("codes", "ids")])
    known = frequent.select("lang", "bucket", F.lit(0).alias("turn"), F.lit(None).cast("bigint").alias("chunk"), F.lit(None).cast("binary").alias("blob"), "codes", "ids")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A bucket's frequent pairs come before the chunks that ask for them.
        where, codes, ids = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.turn == 0:
                    where, codes, ids = (row.lang, row.bucket), np.asarray(row.codes), np.asarray(row.ids)
                elif where == (row.lang, row.bucket):
                    mine = np.cumsum(_unpacked(row.blob, 2)[0])
                    at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
                    hit = codes[at] == mine
                    if hit.any():
                        out.append((row.chunk, _packed(mine[hit], ids[at[hit]])))
            yield _frame(out, "chunk bigint, found binary")

    dealt = known.union(asked).repartition(shuffles(partials), "lang", "bucket").sortWithinPartitions("lang", "bucket", "turn")
    found = dealt.mapInPandas(answer, "chunk bigint, found binary")
    return found.groupBy("chunk").agg(F.collect_list("found").alias("found"))


def _rows(added: DataFrame, size: int, left: str, right: str, more: str | None = None) -> DataFrame:
    rows = added.filter(F.col("size") == size).select("lang", F.explode(F.arrays_zip("codes", "counts", "ids")).alias("x"))
    columns = ["lang", F.expr(_left("x.codes")).alias(left), F.expr(_right("x.codes")).alias(right), F.col("x.counts").alias("a")]
    return rows.select(*columns, *([F.col("x.ids").alias(more)] if more else []))


def _score(a: str, parts: str) -> str:
    return f"(2000000BD * cast({a} as decimal(20,0))) div cast({parts} as decimal(20,0))"


def _scored(df: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Columns l, r, score of the lowest-scoring cut; of equal scores the first."""
    cut = F.array(*[F.struct(F.expr(_score("a", f"{left} + {right}")).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts)])
    return df.withColumn("cut", F.array_min(cut)).withColumns({"l": F.col("cut.l"), "r": F.col("cut.r"), "score": F.col("cut.score")}).drop("cut")


def phrase_counts(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, added): words per language, frequent words with numbers, frequent phrases per bucket."""
    ways = shuffles(docs)
    chunks = chunked(docs.select("lang", "text"), chunk)
    uses = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    uses = uses.select("chunk", "lang", (F.col("at") + 1).alias("at"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    every = stored(uses.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-vocabulary")
    totals = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    words = stored(numbered(every.filter(F.col("f") >= least)), "phrase-numbers")
    # The largest group is the frequent words of one chunk.
    new = uses.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("new"))
    told = chunks.select("chunk", "lang", "ids").join(new, "chunk").select("chunk", "lang", "ids", F.col("new.at").alias("at"), F.col("new.id").alias("new"))
    pairs = stored(told.mapInPandas(_pair_counter(ways), _PARTIAL), "phrase-pairs")
    frequent = _added(pairs, ways, least)
    back = _given_back(pairs, frequent)
    longer = pairs.filter("size = 0").select("chunk", "lang", "seq").join(back, "chunk")
    longer = stored(longer.mapInPandas(_longer_counter(ways), _PARTIAL), "phrase-longer")
    return totals, words, frequent.union(_added(longer, ways, least))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    Per language (null: ``und``), A-Z in lower case. Null and empty texts hold no words, repeated rows count
    again, an empty table gives no row. Other columns of ``docs`` are not read.
    """
    totals, words, added = phrase_counts(docs, least, chunk)
    pair = stored(_rows(added, 2, "i", "j", "id"), "phrase-2")
    three = _rows(added, 3, "p", "q")
    four = _rows(added, 4, "p", "q")
    word = words.select("lang", F.col("id").alias("w"), "word", "f")

    def named(df: DataFrame, *keys: str) -> DataFrame:
        for k in keys:
            df = df.join(word.select("lang", F.col("w").alias(k), F.col("word").alias(f"{k}_word"), F.col("f").alias(f"{k}_f")), ["lang", k])
        return df

    pair = named(pair, "i", "j")
    p = pair.select("lang", F.col("id").alias("p"), F.col("i"), F.col("j"), F.col("a").alias("ij"), "i_word", "j_word", "i_f")
    q = pair.select("lang", F.col("id").alias("q"), F.col("i").alias("k"), F.col("j").alias("m"), F.col("a").alias("km"), F.col("i_word").alias("k_word"), F.col("j_word").alias("m_word"), F.col("j_f").alias("m_f"))
    three = stored(three.join(p, ["lang", "p"]).join(q.drop("k", "k_word"), ["lang", "q"]), "phrase-3")
    # The middle pair of four words, and both phrases of three in them.
    middle = pair.select("lang", F.col("id").alias("mid"), F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("jk"))
    of_three = three.select("lang", "p", "q", F.col("a").alias("n3"))
    four = (
        four.join(p, ["lang", "p"]).join(q, ["lang", "q"]).join(middle, ["lang", "j", "k"])
        .join(of_three.select("lang", "p", F.col("q").alias("mid"), F.col("n3").alias("ijk")), ["lang", "p", "mid"])
        .join(of_three.select("lang", F.col("p").alias("mid"), "q", F.col("n3").alias("jkm")), ["lang", "mid", "q"])
    )
    four = stored(four, "phrase-4")

    # The most frequent longer phrase around each shorter one.
    around3 = four.select("lang", F.explode(F.array(F.struct("p", F.col("mid").alias("q")), F.struct(F.col("mid").alias("p"), "q"))).alias("x"), "a")
    around3 = around3.groupBy("lang", "x.p", "x.q").agg(F.max("a").alias("around"))
    around2 = three.select("lang", F.explode(F.array("p", "q")).alias("id"), "a").union(four.select("lang", F.explode(F.array("p", "mid", "q")), "a"))
    around2 = around2.groupBy("lang", "id").agg(F.max("a").alias("around"))
    left = f"around is null or 100BD * cast(around as decimal(20,0)) < {covered}BD * cast(a as decimal(20,0))"
    out2 = _scored(pair.join(around2, ["lang", "id"], "left").filter(left), [("i_f", "j_f")])
    out3 = _scored(three.join(around3, ["lang", "p", "q"], "left").filter(left), [("i_f", "km"), ("ij", "m_f")])
    out4 = _scored(four, [("i_f", "jkm"), ("ij", "km"), ("ijk", "m_f")])
    texts = (("i", "j"), ("i", "j", "m"), ("i", "j", "k", "m"))
    found = None
    for df, parts in zip((out2, out3, out4), texts):
        phrase = F.concat_ws(" ", *[F.col(f"{c}_word").cast("string") for c in parts]).alias("phrase")
        rows = df.select("lang", phrase, "a", "l", "r", "score")
        found = rows if found is None else found.union(rows)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

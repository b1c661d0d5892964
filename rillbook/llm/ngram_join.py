"""Similarity join of documents on the Jaccard similarity of their word n-gram sets, by MinHash banding.

Documents with one n-gram set are one node. Nodes that share a band hash are candidates; candidate
components are cut into blocks, and every pair of blocks is verified on the full n-gram sets in a task
of its own. A task gives link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from rillbook.llm.common import packed, shuffles, stored, stored_in_buckets, unpacked

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995
#: At most so many hash functions; more rows in a band mean fewer false candidates.
MAX_HASHES = 192
#: Rows of a stored table that share a bitmap, as a power of two up to 15.
SLICE = 12
#: Nodes in a block of a component.
BLOCK = 400


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands enough for the recall stay within the hash functions.

    A pair of exactly this similarity shares a band with probability 1 - (1 - s^rows)^bands.
    """
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hash functions")
    return best


_MULTIPLY, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams; a shorter text is one n-gram, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ codes[i : i + len(out)]) * _MULTIPLY
        out ^= out >> _SHIFT
    return np.unique(out)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240131)
    a, b = draw.integers(0, 2**32, (2, count), dtype=np.uint64)
    return (a | np.uint64(1)).astype(np.uint32)[:, None], b.astype(np.uint32)[:, None]


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = ((grams * _MULTIPLY) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(mixed), 2048):
        np.minimum(out, (mixed[None, at : at + 2048] * a + b).min(1), out=out)
    return out


_SKETCH = "n_grams bigint, h1 bigint, h2 bigint, bands array<bigint>"


def _slice():
    return F.shiftright("rid", SLICE)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sketcher(n: int, bands: int, rows: int):
    def sketch(texts: pd.Series) -> pd.DataFrame:
        a, b = _permutations(bands * rows)
        out = []
        for text in texts:
            grams = shingles(text, n)
            if not len(grams):
                out.append((0, None, None, []))
                continue
            whole = xxhash.xxh3_128_intdigest(grams.tobytes())
            sig = signature(grams, a, b)
            keys = [_signed(xxhash.xxh3_64_intdigest(sig[i * rows : (i + 1) * rows].tobytes(), seed=i)) for i in range(bands)]
            out.append((len(grams), _signed(whole >> 64), _signed(whole & (1 << 64) - 1), keys))
        frame = pd.DataFrame(out, columns=["n_grams", "h1", "h2", "bands"])
        return frame.astype({"h1": "Int64", "h2": "Int64"})

    return F.pandas_udf(sketch, _SKETCH)


def components(edges: DataFrame, name: str = "components", rounds: int = 50) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node of its component.

    Large-star and small-star steps in turn, each one aggregate and one join, until nothing changes.
    Every round is a stored table. Raises if ``rounds`` do not suffice.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    mark = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        moved = small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stored(moved.distinct(), name)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            tops = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tops.select("node", F.col("node").alias("root")))
        mark = seen
    raise RuntimeError("the components did not settle")


def _block_counts(frame: pd.DataFrame, n: int, similarity: float):
    """Linked weight and linked nodes of each row, and forest edges, for one pair of blocks of one component."""
    sets = [shingles(t, n) for t in frame.text]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        at, to = np.searchsorted(code, [low, low + width])
        has = np.zeros((len(sets), min(width, int(code[-1]) + 1 - low)), np.float32)
        has[owner[at:to], code[at:to] - low] = 1
        common += has @ has.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= similarity * union - 1e-6
    np.fill_diagonal(linked, False)
    side = frame.own.to_numpy()
    if (side != side[0]).any():
        linked &= side[:, None] != side[None, :]
    copies, node = frame.n_copies.to_numpy(), frame.node.to_numpy()
    root, left = np.full(len(node), -1), np.ones(len(node), bool)
    for i in range(len(node)):
        if not left[i]:
            continue
        todo, left[i], root[i] = [i], False, i
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & left)
            left[new], root[new] = False, i
            todo += new.tolist()
    return linked @ copies, linked.sum(1), node[root]


_LINKS = "node bigint, linked bigint, linked_sets bigint, top bigint"


def _verifier(n: int, similarity: float):
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["root", "lo", "hi"], sort=False):
            linked, sets, top = _block_counts(part, n, similarity)
            out.append(pd.DataFrame({"node": part.node.to_numpy(), "linked": linked, "linked_sets": sets, "top": top}))
        return pd.concat(out)

    return verify


def linked_sets(sketched: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(h1, h2, n_copies, first_id, linked, linked_sets, class) per distinct n-gram set of a sketched table."""
    ways = shuffles(sketched)
    full = sketched.filter("sketch.n_grams > 0").select("row.doc_id", "row.text", "sketch.*")
    nodes = stored(
        full.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "ngram-nodes",
    )
    keys = nodes.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    near = keys.join(heads.select("key", "head"), "key").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = components(near, "ngram-candidates")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = stored(
        nodes.select("node", "h1", "h2", "n_copies")
        .join(groups, "node")
        .join(sizes, "root")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")),
        "ngram-members",
    )
    texts = (
        full.select("h1", "h2", "text").join(members.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").agg(F.first("text").alias("text"))
    )
    placed = (
        members.join(texts, ["h1", "h2"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        # Components of one block share tasks; each pair of blocks of a larger one is a task of its own.
        .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(8 * ways))).otherwise(F.xxhash64("root", "lo", "hi")))
        .select("task", "root", "lo", "hi", "own", "node", "n_copies", "text")
    )
    found = stored(placed.groupBy("task").applyInPandas(_verifier(n, similarity), _LINKS), "ngram-links")
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"), F.sum("linked_sets").alias("linked_sets"))
    classes = components(found.select(F.col("node").alias("a"), F.col("top").alias("b")), "ngram-classes")
    return (
        nodes.select("node", "h1", "h2", "n_copies", "first_id")
        .join(counts, "node", "left")
        .join(classes, "node", "left")
        .select(
            "h1", "h2", "n_copies", "first_id",
            F.coalesce("linked", F.lit(0)).alias("linked"),
            F.coalesce("linked_sets", F.lit(0)).alias("linked_sets"),
            F.coalesce("root", "node").alias("class"),
        )
    )


def joined(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The stored rows (row, rid, slice, sketch), and per rid (doc_id, n_grams, class, class_id, n_copies, n_links, n_text_links).

    ``class`` is null for documents without words: they take no part. ``class_id`` is the smallest id of
    the class, or the own id without words. ``n_links`` counts the other documents at or above the
    similarity, copies included; ``n_text_links`` the other n-gram sets. Null ids take part.
    """
    bands, per_band = bands_for(similarity, recall)
    rows = packed(docs).select("row", F.monotonically_increasing_id().alias("rid"))
    table = rows.select("row", "rid", _slice().alias("slice"), _sketcher(n, bands, per_band)(F.col("row.text")).alias("sketch"))
    table = stored_in_buckets(table, "ngram-sketch", "slice")
    sets = linked_sets(table, n, similarity)
    sets = stored(sets, "ngram-sets")
    first = sets.groupBy("class").agg(F.min("first_id").alias("class_first"))
    sets = stored(sets.join(first, "class"), "ngram-classed")
    mine = table.select("rid", "row.doc_id", "sketch.n_grams", "sketch.h1", "sketch.h2")
    worded = mine.filter("n_grams > 0").join(sets, ["h1", "h2"])
    empty = mine.filter("n_grams = 0")
    links = F.col("linked") + F.col("n_copies") - 1
    found = worded.select(
        "rid", "doc_id", "n_grams", "class", F.col("class_first").alias("class_id"), "n_copies",
        links.alias("n_links"), F.col("linked_sets").alias("n_text_links"),
    ).union(
        empty.select(
            "rid", "doc_id", "n_grams", F.lit(None).cast("bigint"), "doc_id", F.lit(1).cast("bigint"),
            F.lit(0).cast("bigint"), F.lit(0).cast("bigint"),
        )
    )
    return table, found


def join_report(docs: DataFrame, **how) -> DataFrame:
    """Class and number of links of every document."""
    _, found = joined(docs.select("doc_id", "text"), **how)
    return found.select("doc_id", "class_id", "n_copies", "n_links", "n_text_links", "n_grams")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, that with the smallest id, with all columns; documents without words stay.

    Of rows with one id, or of a class without ids, one stays. The texts stay where they are: the numbers of
    the rows that stay are dealt out, one bit a row, to the slices of the table they lie in.
    """
    table, found = joined(docs, **how)
    first = found.filter(F.col("class").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = first.groupBy(F.coalesce("class", -1 - F.col("rid")).alias("class")).agg(F.min("rid").alias("rid")).select("rid")
    bits = keep.groupBy(_slice().alias("slice")).agg(F.bitmap_construct_agg(F.col("rid").bitwiseAND((1 << SLICE) - 1)).alias("bits"))
    # One row a slice, so it is the hashed side, whatever its size.
    here = table.join(stored(bits, "ngram-kept").hint("shuffle_hash"), "slice")
    return unpacked(here.filter(f"conv(hex(substring(bits, cast((rid & {(1 << SLICE) - 1}) div 8 + 1 as int), 1)), 16, 10) & (1 << cast(rid & 7 as int)) <> 0"))

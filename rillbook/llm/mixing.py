"""Mix sources to target weights.

Every row gets a hash-random key. Rows are sorted by (source, key) over ranges, prefix sums of word
counts are built from one sum per range and source, and only the range that holds a source's cut is
walked row by row. A source whose target exceeds its words is repeated in whole epochs before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rillbook.llm.common import WORD, packed, shuffles, stored, unpacked

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most so many times.
MAX_EPOCHS = 3
#: Changing it draws another mix.
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Words to take from each source; ``sizes`` has one row (source, source_size) per source.

    Sources share all words by weight, but none gives more than ``max_epochs`` times its size; what a
    capped source cannot give is shared by the others. Sorted by size per weight the capped sources
    come first, so one pass with prefix sums finds them.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("bigint")
    ranked = sizes.select("source", "source_size", weight.alias("weight")).withColumn(
        "ratio", F.col("source_size") / F.col("weight")
    )
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    cap = F.col("source_size") * max_epochs
    shared = ranked.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left_words"),
        F.sum("weight").over(after).alias("left_weight"),
    )
    open_ = F.col("left_words").cast("double") / F.col("left_weight")
    capped = cap.cast("double") <= F.col("weight") * open_
    # The first open source fixes the share of one unit of weight for all open ones.
    share = F.max(F.when(~capped, open_)).over(whole)
    return shared.select(
        "source", "source_size", F.when(capped, cap.cast("double")).otherwise(F.col("weight") * share).alias("target")
    )


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """(row, source, size, mix_key) of every document; equal ids get equal keys."""
    rows = packed(docs)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))))
    return rows.select(
        "row", F.col("row.source").alias("source"), word_count(F.col("row.text")).alias("size"), key.alias("mix_key")
    )


def _cuts(keyed: DataFrame, weights, max_epochs: int) -> DataFrame:
    """One row per source: target, whole epochs, and the key and size at which the last epoch ends."""
    ways = shuffles(keyed)
    units = keyed.groupBy("source", "mix_key", "size").agg(F.count(F.lit(1)).alias("copies"))
    # Stored, so that the ranges are the same in every later pass.
    ranged = stored(
        units.repartitionByRange(ways, F.col("source").asc_nulls_last(), "mix_key", "size")
        .withColumn("part", F.spark_partition_id())
        .withColumn("words", F.col("size") * F.col("copies")),
        "mix-ranges",
    )
    sums = ranged.groupBy("source", "part").agg(F.sum("words").alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.col("source_size"))).cast("bigint")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))

    upto = W.partitionBy("source").orderBy("part")
    ends = sums.select(F.col("source").alias("s"), "part", F.sum("words").over(upto).alias("end"), F.col("words").alias("in_part"))
    spot = (
        ends.join(plan, F.col("s").eqNullSafe(F.col("source")))
        .filter((F.col("end") - F.col("in_part") < F.col("rest")) & (F.col("rest") <= F.col("end")))
        .select("s", F.col("part").alias("p"), (F.col("end") - F.col("in_part")).alias("start"), F.col("rest").alias("budget"))
    )
    here = ranged.join(spot, F.col("s").eqNullSafe(F.col("source")) & (F.col("part") == F.col("p")))
    walk = W.partitionBy("source").orderBy("mix_key", "size")
    walked = here.withColumn("end", F.col("start") + F.sum("words").over(walk))
    cut = walked.filter((F.col("end") >= F.col("budget")) & (F.col("end") - F.col("words") < F.col("budget"))).select(
        F.col("source").alias("s"),
        F.col("mix_key").alias("cut_key"),
        F.col("size").alias("cut_size"),
        # Equal rows at the cut share what is left of the budget.
        F.floor((F.col("budget") - (F.col("end") - F.col("words"))) / F.col("copies")).cast("bigint").alias("cut_take"),
    )
    return plan.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")


def decisions(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(row, source, size, source_size, target, epochs, tail, taken) per document.

    ``epochs`` whole repeats, then ``tail`` words of the last, partial epoch: all of a document before
    the cut of its source, part of the one at the cut, none after it. So a source's taken words are
    the whole part of its target. Rows with one id, source and size are one unit of the order; at the
    cut they share the rest evenly, rounded down. Null texts have no words. Null sources are a source.
    """
    keyed = _keyed(docs, seed)
    ways = shuffles(keyed)
    cuts = _cuts(keyed.drop("row"), weights, max_epochs)
    # A source may hold a third of all rows: its one row is copied to as many salts as there are partitions.
    salted = stored(
        cuts.withColumnRenamed("source", "cut_source").withColumn("cut_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))),
        "mix-cuts",
    )
    rows = keyed.withColumn("salt", F.pmod(F.xxhash64("mix_key"), F.lit(ways)).cast("int"))
    joined = rows.join(salted, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("salt") == F.col("cut_salt")))
    early = (F.col("mix_key") < F.col("cut_key")) | ((F.col("mix_key") == F.col("cut_key")) & (F.col("size") < F.col("cut_size")))
    at = (F.col("mix_key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))
    tail = F.when(early, F.col("size")).when(at, F.col("cut_take")).otherwise(F.lit(0)).cast("bigint")
    return joined.select(
        "row", "source", "size", "source_size", "target", "epochs", tail.alias("tail"),
        (F.col("size") * F.col("epochs") + tail).alias("taken"),
    )


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """What the mix takes of every document."""
    return decisions(docs.select("doc_id", "source", "text"), **how).select(
        F.col("row.doc_id").alias("doc_id"), "source", "size", "source_size", "target", "epochs", "taken"
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row for every whole repeat, and for the document at the cut one with its first words.

    Documents of which nothing is taken go; those without words have nothing to take. ``n_chars``, where
    there is such a column, follows a shortened text. All columns stay.
    """
    rows = decisions(docs, **how).filter(F.col("taken") > 0)
    text = F.col("row.text")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.slice(pieces, 1, F.greatest(F.col("tail").cast("int"), F.lit(1))), "")
    whole = (F.col("epochs") + F.when(F.col("tail") == F.col("size"), F.lit(1)).otherwise(F.lit(0))).cast("int")
    cut = (F.col("tail") > 0) & (F.col("tail") < F.col("size"))
    texts = F.concat(F.array_repeat(text, whole), F.when(cut, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = rows.select("row", F.explode(texts).alias("taken_text"))
    new = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("taken_text") == text, F.col("row.n_chars")).otherwise(F.length("taken_text")).cast(kind)
    return unpacked(out, replaced=new)


def oracle(weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """What :func:`mix_report` gives, in DuckDB's SQL."""
    turns = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
    WITH sized AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
        md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS mix_key FROM documents),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {turns} END AS weight FROM sizes),
    shared AS (
      SELECT *, sum(source_size) OVER () - coalesce(sum({max_epochs} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
      FROM weighed WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
    opened AS (SELECT *, CAST(left_words AS DOUBLE) / CAST(left_weight AS DOUBLE) AS share FROM shared),
    capped AS (SELECT *, CAST({max_epochs} * source_size AS DOUBLE) <= weight * share AS is_capped FROM opened),
    targets AS (
      SELECT source, source_size, CASE WHEN is_capped THEN CAST({max_epochs} * source_size AS DOUBLE)
        ELSE weight * max(CASE WHEN NOT is_capped THEN share END) OVER () END AS target FROM capped),
    plan AS (
      SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS epochs FROM targets),
    ranked AS (
      SELECT s.*, p.source_size, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size AS rest,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mix_key, s.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        count(*) OVER (PARTITION BY s.source, s.mix_key, s.size) AS copies
      FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, source, size, source_size, target, CAST(epochs AS BIGINT) AS epochs,
      CAST(size * epochs + CASE WHEN upto <= rest THEN size
        ELSE greatest(0, floor((rest - (upto - size * copies)) / copies)) END AS BIGINT) AS taken
    FROM ranked"""

"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import spare_names, stage_table, with_global_rank, word_count

#: Copies are counted in units of 2**-24, in whole numbers, so that no rounding error adds a copy.
ONE = 1 << 24


def source_targets(sizes: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_rows, target) for the rows (source, size).

    Sources by code point, null last, take the weights in turn and share `share` times all sizes. A target stops at
    `most` times its source's size; what exceeds it is shared anew by weight until none is above. Each round is one
    aggregate of sums over the sources, of which only two numbers reach the driver.
    """
    per = stage_table(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "sources")
    ranked = with_global_rank(per, [F.col("source").asc_nulls_last()], "at", "source_order")
    turn = F.pmod(F.col("at"), F.lit(len(weights))).cast("int")
    t = stage_table(ranked.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[turn]).drop("at"), "weighted")
    cap, level, n_full = F.col("source_size") * most, 0.0, -1
    total = share * (t.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("weight") * level >= cap
        a = t.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if a[0] == n_full or not a[2]:
            break
        n_full, level = a[0], max(level, (total - a[1]) / a[2])
    return t.select("source", "source_size", "n_rows", F.least(F.col("weight") * level, cap).alias("target"))


def _tie(docs: DataFrame, seed: int) -> F.Column:
    """A hash of all columns of a row; rows that differ anywhere nearly always differ in it."""
    return F.xxhash64(F.lit(seed), *[F.to_json(c) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])


def _with_copies(rows: DataFrame, tie: str, weights, share: float, most: float, seed: int) -> DataFrame:
    """rows, which have source and size, with source_size, target and copies; tie orders what is of one source and size."""
    rank, key = spare_names(rows, "mix_rank", "mix_key")
    ranked = with_global_rank(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.col(tie)], rank, "mix")
    targets = stage_table(source_targets(ranked.select("source", "size"), weights, share, most), "targets")
    first = targets.select(F.col("source").alias(key), "source_size", "n_rows", "target")
    ahead = stage_table(ranked.groupBy(F.col("source").alias(key)).agg(F.min(rank).alias("mix_first")), "first")
    first = first.join(ahead, first[key].eqNullSafe(ahead[key])).drop(ahead[key])
    out = ranked.join(first, ranked["source"].eqNullSafe(first[key])).drop(first[key])
    step = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * ONE).otherwise(0.0))
    start = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(seed)), F.lit(ONE)) + (F.col(rank) - F.col("mix_first")) * step
    whole = lambda c: F.shiftright(c, 24)
    return out.withColumn("copies", whole(start + step) - whole(start)).drop(rank, "n_rows", "mix_first")


def plan_mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 42, text: str = "text") -> DataFrame:
    """docs without text, with size (words of the text; null: 0), source_size, target and copies.

    Within a source the documents stand in order of size, ties by a hash; each expects target / source_size copies.
    Their prefix sum is the rank times that; a random offset of the source is added once, and a document is taken once
    for every whole number that its step crosses. The order by size keeps each source's words near its target. The same
    rows and seed give the same mix. Texts are counted and hashed where they are; none is moved.

    Null sources are one source; null and empty texts have size 0; repeated rows are counted each; a source without
    words has target 0 and no copies. Columns of docs named like a result are replaced; others stay.
    """
    (tie,) = spare_names(docs, "mix_tie")
    rows = docs.drop(*(c for c in ("size", "source_size", "target", "copies") if c != text)).withColumns({"size": word_count(F.col(text)), tie: _tie(docs, seed)})
    return _with_copies(rows if text == "size" else rows.drop(text), tie, weights, share, most, seed).drop(tie)


def mix_sources(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 42, text: str = "text") -> DataFrame:
    """The mix itself: docs, each row as often as plan_mix takes it.

    The plan is made of sources, sizes and hashes; a row finds its copies by hash and size. Rows that are wholly equal
    share theirs: each gives the whole part, one of them the rest.
    """
    size, tie, n, whole, rest = spare_names(docs, "mix_size", "mix_tie", "mix_copy", "mix_whole", "mix_rest")
    keyed = docs.withColumns({size: word_count(F.col(text)), tie: _tie(docs, seed)})
    plan = _with_copies(keyed.select("source", F.col(size).alias("size"), tie), tie, weights, share, most, seed)
    plan = plan.groupBy(F.col("size").alias(size), tie).agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n")).where("c > 0")
    plan = stage_table(plan.select(size, tie, F.floor(F.col("c") / F.col("n")).alias(whole), F.pmod("c", "n").alias(rest)), "copies")
    times = lambda d, c: d.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(c).cast("int")))).select(*docs.columns)
    each = times(keyed.join(plan.where(F.col(whole) > 0).hint("merge"), [size, tie]), whole)
    over = plan.where(F.col(rest) > 0)
    if over.isEmpty():
        return each
    return each.unionByName(times(keyed.join(over, [size, tie]).dropDuplicates([size, tie]), rest))

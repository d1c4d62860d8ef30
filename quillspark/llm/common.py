"""Shared building blocks of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import drop_staged, shared_dir, stage_table  # noqa: F401

#: ASCII white space as the operators see it: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(c) -> F.Column:
    """The words of a text, an empty array for null or blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def word_count(c) -> F.Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def maybe_among(df: DataFrame, column: str, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of df whose column may be among those of wanted: all that are, and few others while wanted is small.

    The hashes of wanted set bits of a bitmap, which is sent as a table of 4 kB rows, so many at most that it has `bits`
    bits; no more of it ever moves. An exact join follows.
    """
    at, mark, bucket, marks = spare_names(df, "maybe_at", "maybe_bit", "maybe_bucket", "maybe_marks")
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    said = wanted.select(spread(column).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(marks))
    out = df.withColumn(at, spread(column)).withColumns({bucket: F.bitmap_bucket_number(at), mark: F.bitmap_bit_position(at)}).join(F.broadcast(said), bucket)
    return out.where(F.expr(f"getbit(cast(conv(hex(substring({marks}, cast({mark} div 8 as int) + 1, 1)), 16, 10) as int), cast({mark} % 8 as int)) = 1")).select(*df.columns)


def with_global_rank(df: DataFrame, order: list, rank: str, name: str = "ranked") -> DataFrame:
    """df with its 0-based position in a total order, without a window over everything.

    Range partitions are sorted and written once; the row counts of the partitions, one row each, give offsets.
    Rows that tie in every order column get some order among themselves.
    """
    pos, part = spare_names(df, "rank_pos", "rank_part")
    n = partitions(df.sparkSession)
    t = stage_table(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(pos, F.monotonically_increasing_id()), name)
    counts = t.groupBy(F.shiftright(pos, 33).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.agg(F.sort_array(F.collect_list(F.struct(part, "n"))).alias("a"))  # one entry for each partition written
    before = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + F.when(x[part] < F.col(part), x["n"]).otherwise(0))
    offsets = pairs.select("a", F.explode("a").alias("x")).select("a", F.col(f"x.{part}").alias(part)).select(part, before.alias("before"))
    out = t.withColumn(part, F.shiftright(pos, 33)).join(F.broadcast(offsets), part)
    return out.withColumn(rank, F.col("before") + F.col(pos).bitwiseAND((1 << 33) - 1)).drop(part, pos, "before")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the long columns a, b of edges; component is the smallest node reachable.

    Alternates large-star and small-star steps until all edges are stars. Each step groups by a node for its
    smallest neighbour and joins that back, so no neighbour list is ever gathered.
    """
    e = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # done once every node has one edge down, and what it leads to has none
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, stage_table(rest.unionByName(low.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        drop_staged(before)

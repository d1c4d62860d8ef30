"""Sharding: balanced label propagation over documents that share a link key, then exact row quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import spare_names, stage_table, with_global_rank

#: Wishes are sorted into halving classes of size and each class into this many hash buckets: quotas are cut on a table of
#: shards x 63 classes x buckets, whose size does not grow with the documents.
BUCKETS = 256


def _moves(tally: DataFrame, sizes: DataFrame, shards: int, quota: int, turn: int) -> DataFrame:
    """(link, shard, to, number): how many members of a link move from one shard to another in this round.

    A link's members move towards the shard with room where most of them are: from shards with fewer, or, if all of the
    link fits there, from a full one with more as well. A shard takes what its quota has room for, small groups first;
    the last ones to find room may move in part. A shard counts as full when less is left than such rounding leaves.
    """
    w = Window.partitionBy("link")
    sizes = F.broadcast(sizes.select("shard", F.greatest(F.lit(quota) - F.col("n"), F.lit(0)).alias("room")))  # a row for each shard
    mine = F.struct("n", (F.col("room") >= max(1, min(shards, quota // 8))).alias("open"), F.xxhash64("link", "shard").alias("tie"), "shard", "room")
    state = tally.join(sizes, "shard").withColumn("mine", mine)
    state = state.withColumns({"best": F.max(F.when(F.col("mine.open"), F.col("mine"))).over(w), "whole": F.sum("n").over(w)})
    wish = state.where("shard <> best.shard and (mine < best or whole - best.n <= best.room)").select("link", "shard", F.col("best.shard").alias("to"), "n", F.col("best.n").alias("there"))
    wish = wish.withColumns({"class": F.floor(F.log2(F.col("there") + 1)).cast("int"), "bucket": F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(BUCKETS)).cast("int")})
    cells = wish.groupBy("to", "class", "bucket").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("to").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0))).join(sizes.withColumnRenamed("shard", "to"), "to")
    # what is left for a cell: all of it, or a share of each group in it
    cells = cells.select("to", "class", "bucket", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("room") - F.col("before")) / F.col("m"))).alias("share"))
    return wish.join(F.broadcast(cells.where("share > 0")), ["to", "class", "bucket"]).select("link", "shard", "to", F.floor(F.col("n") * F.col("share")).alias("number")).where("number > 0")


def propagate(tally: DataFrame, shards: int, quota: int, rounds: int = 10) -> DataFrame:
    """(link, shard, n): how many members of each link belong in each shard, after label propagation.

    tally has the same columns: how many members of each link begin in each shard. Each round joins every link's
    tally with the shard most of its members are in. Members of one link are alike, so counts describe them: the state
    is at most `shards` rows for each link, whatever the size of the link.
    """
    for turn in range(rounds):
        sizes = tally.groupBy("shard").agg(F.sum("n").alias("n"))
        sizes = tally.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(sizes, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))
        moves = stage_table(_moves(tally, sizes, shards, quota, turn), "moves")
        if moves.isEmpty():
            break
        change = moves.select("link", "shard", (-F.col("number")).alias("n")).unionByName(moves.select("link", F.col("to").alias("shard"), F.col("number").alias("n")))
        tally = stage_table(tally.unionByName(change).groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "tally")
    return tally


def shard_rows(rows: DataFrame, shards: int = 8, rounds: int = 10) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard); counts differ by one at most.

    rows need the column `link`; rows with the same link want to be together. Null links, and links that occur once,
    bind nothing: such rows go where there is room. A link too large for a shard fills some and shares another.
    Repeated rows count each; no rows give none. Columns of rows named shard or slot are replaced; others stay.
    """
    rows = rows.drop("shard", "slot")
    tie, at, first_at, spans = spare_names(rows, "row_tie", "at", "link_at", "spans")
    base = stage_table(rows.withColumn(tie, F.monotonically_increasing_id()), "rows")
    quota, more = divmod(base.count(), shards)
    # counted by link and first shard before anything meets by link alone: a hot link has `shards` rows
    tally = base.where("link is not null").groupBy("link", F.pmod(F.xxhash64(tie, "link"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    tally = stage_table(tally.withColumn("all", F.sum("n").over(Window.partitionBy("link"))).where("all > 1").drop("all"), "tally")
    tally = propagate(tally, shards, quota, rounds)
    # the k-th member of a link goes to the shard whose share of the link k falls into
    w = Window.partitionBy("link").orderBy(F.desc("n"), "shard")
    shares = tally.select("link", F.col("shard").alias("to"), (F.sum("n").over(w) - F.col("n")).alias("from_k"), F.sum("n").over(w).alias("to_k"))
    shares = shares.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("from_k", "to_k", "to"))).alias(spans))  # at most one for each shard
    ranked = with_global_rank(base, [F.col("link"), F.col(tie)], at, "by_link")
    starts = ranked.groupBy("link").agg(F.min(at).alias(first_at))
    placed = ranked.join(shares.join(starts, "link"), "link", "left")
    k = F.col(at) - F.col(first_at)
    placed = placed.withColumn("shard", F.get(F.filter(spans, lambda s: (s["from_k"] <= k) & (k < s["to_k"])), F.lit(0))["to"]).drop(spans, first_at, at)
    # quotas: the linked rows of a shard up to its quota stay; all others fill what room is left, in order
    placed = with_global_rank(placed, [F.col("shard").asc_nulls_last(), F.col("link"), F.col(tie)], at, "by_shard")
    counts = {r["shard"]: (r["n"], r["f"]) for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("f")).collect()}  # a row for each shard
    room = [quota + (s < more) for s in range(shards)]
    stay = [min(counts.get(s, (0, 0))[0], room[s]) for s in range(shards)]
    begin = [counts.get(s, (0, 0))[1] for s in range(shards)]
    rank = F.lit(None).cast("long")
    for s in range(shards):
        rank = F.when(F.col("shard") == s, F.when(F.col(at) - begin[s] < stay[s], F.col(at) - begin[s])).otherwise(rank)
    placed = placed.withColumn("slot", rank)
    kept = placed.where("slot is not null").drop(at)
    spare = with_global_rank(placed.where("slot is null").drop("slot", "shard", at), [F.col("link"), F.col(tie)], at, "spare")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        free = room[s] - stay[s]
        mine = (F.col(at) >= begin) & (F.col(at) < begin + free)
        shard, slot = F.when(mine, F.lit(s)).otherwise(shard), F.when(mine, F.col(at) - begin + stay[s]).otherwise(slot)
        begin += free
    spare = spare.withColumns({"shard": shard, "slot": slot}).drop(at)
    return kept.select(*spare.columns).unionByName(spare).drop(tie)


def text_link(text: str = "text") -> F.Column:
    """Equal texts, null and empty ones too, have one link."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 10) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, link, shard, slot for each row of docs; equal texts are linked.

    Null texts have size 1 and, like empty ones, checksum 0. Other columns of docs are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_link().alias("link"))
    return shard_rows(rows, shards, rounds)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write docs by shard: one folder for each, in order of slot. placed: what shard_documents makes of the same docs.

    A row finds its place by doc_id and text, nulls too; rows that repeat both take their places in turn, so every row
    is written once. Columns of docs named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    link, turn = spare_names(docs, "shard_link", "shard_turn")
    nth = F.row_number().over(Window.partitionBy("doc_id", link).orderBy(F.lit(0)))
    l = docs.withColumn(link, text_link()).withColumn(turn, nth)
    r = placed.select("doc_id", F.col("link").alias(link), "shard", "slot").withColumn(turn, nth)
    out = l.join(r, l["doc_id"].eqNullSafe(r["doc_id"]) & (l[link] == r[link]) & (l[turn] == r[turn])).select(*[l[c] for c in docs.columns], "shard", "slot")
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Vector retrieval: pluggable embedding, exact block search, an inverted file and hyperplane hashing."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import stage_table

#: A task multiplies a block of at most about so many queries with one of so many vectors.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 16_384
#: Queries of a block that are multiplied at once.
ROWS = 256
#: The centres of an inverted file are fitted on so many vectors at most, the first by a hash of their keys.
FIT_VECTORS, MOST_LISTS = 20_000, 4096


def hashing_embedder(dims: int = 64) -> Callable[[pd.Series], pd.Series]:
    """The offline default: signed counts of hashed words."""
    import zlib

    def embed_series(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1 if h & 0x10000 else -1
            out.append(v)
        return pd.Series(out)

    return embed_series


def embed(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str = "text", out: str = "embedding") -> DataFrame:
    """df with a unit vector for each text, by any function from a series of texts to one of vectors."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return fn(texts).map(lambda v: (np.asarray(v) / (np.linalg.norm(v) or 1.0)).astype(np.float32))

    return df.withColumn(out, run(F.col(text)))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 12, scope: DataFrame | None = None, digits: int = 6, same: str | None = None) -> DataFrame:
    """TK3: (query_id, key, rank, distance): the k nearest by 1 - cosine.

    A stated set of queries is compared with all vectors in blocks: both sides are dealt into blocks of bounded size,
    each pair of blocks is a group that one task multiplies, keeping k candidates a query, and the best of all are
    picked at the end. A scope is applied first: either rows (query_id, key), whose pairs are joined, or same, a column
    of both sides that must be equal, which is applied within the blocks.
    """
    more = [same] if same else []
    q = queries.select("query_id", "embedding", *more)
    near = _pair_distances(q, vectors, scope, digits) if scope is not None else _block_topk(q, vectors.select("key", "embedding", *more), k, digits, same)
    w = Window.partitionBy("query_id").orderBy("distance", "key")  # Spark cuts to k before the shuffle as well
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "key", "rank", "distance")


def _pair_distances(q: DataFrame, vectors: DataFrame, pairs: DataFrame, digits: int) -> DataFrame:
    pairs = pairs.join(q, "query_id").join(vectors.select("key", F.col("embedding").alias("other")), "key")
    return pairs.select("query_id", "key", F.round(1 - _cosine("embedding", "other"), digits).alias("distance"))


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _block_topk(q: DataFrame, vectors: DataFrame, k: int, digits: int, same: str | None, among: Callable | None = None) -> DataFrame:
    """k candidates of each block of vectors for each query: a row of blocks for each side, met by an equality join on the pair."""
    n_q, n_v = q.count(), vectors.count()
    cores = q.sparkSession.sparkContext.defaultParallelism
    a = max(1, -(-n_q // QUERY_BLOCK))
    b = max(1, -(-n_v // VECTOR_BLOCK), min(cores, n_v // 512) // a)
    mine = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(a)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    theirs = vectors.withColumn("vb", F.pmod(F.xxhash64("key"), F.lit(b)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    return _best_of_blocks(mine, theirs, ["qb", "vb"], k, digits, same, among)


def _best_of_blocks(mine: DataFrame, theirs: DataFrame, block: list[str], k: int, digits: int, same: str | None = None, among: Callable[[pa.Table, pa.Table], Callable[[int], np.ndarray]] | None = None) -> DataFrame:
    """(query_id, key, distance): the k nearest vectors of each block for each of its queries, one task a block.

    among, given both sides, tells which rows of the right a row of the left is compared with; by default all.
    """

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys = left["query_id"].to_numpy(), right["key"].to_numpy()
        if not len(ids) or not len(keys):
            return pa.table({"query_id": pa.array([], left.schema.field("query_id").type), "key": pa.array([], right.schema.field("key").type), "distance": pa.array([], pa.float64())})
        codes = [pa.chunked_array([*left[same].chunks, *right[same].chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()] if same else []
        vecs = _unit(right["embedding"])
        parts = []
        if among:
            own, picks, far = among(left, right), [np.zeros(0, np.int64)], [np.zeros(0)]
            for at in range(0, len(ids), ROWS):
                for i, x in enumerate(_unit(left["embedding"].slice(at, ROWS)), at):
                    of = own(i)
                    d = np.round(1 - vecs[of] @ x, digits) + 0.0
                    best_of = np.lexsort((keys[of], d))[:k] if len(of) <= 4 * k else _few(d, keys[of], k)
                    picks.append(of[best_of])
                    far.append(d[best_of])
            rows = np.repeat(np.arange(len(ids)), [len(p) for p in picks[1:]])
            return pa.table({"query_id": left["query_id"].take(pa.array(rows)), "key": right["key"].take(pa.array(np.concatenate(picks))), "distance": np.concatenate(far)})
        for at in range(0, len(ids), ROWS):  # bounded memory, however many queries a block has
            rows = slice(at, at + ROWS)
            d = np.round(1 - _unit(left["embedding"].slice(at, ROWS)) @ vecs.T, digits) + 0.0  # no negative zero
            for c in codes:
                d[c[: len(ids)][rows, None] != c[None, len(ids) :]] = np.inf
            picks = [np.lexsort((keys, row))[:k] if len(keys) <= 4 * k else _few(row, keys, k) for row in d]
            far = np.concatenate([row[p] for row, p in zip(d, picks, strict=True)])
            parts.append(pa.table({"query_id": left["query_id"].take(pa.array(at + np.repeat(np.arange(len(picks)), [len(p) for p in picks]))), "key": right["key"].take(pa.array(np.concatenate(picks))), "distance": far}).filter(pa.array(np.isfinite(far))))
        return pa.concat_tables(parts)

    pairs = mine.groupBy(*block).cogroup(theirs.groupBy(*block))
    return pairs.applyInArrow(best, f"query_id {dict(mine.dtypes)['query_id']}, key {dict(theirs.dtypes)['key']}, distance double")


def _few(d: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    limit = np.partition(d, k - 1)[k - 1]
    near = np.flatnonzero(d <= limit)
    return near[np.lexsort((keys[near], d[near]))[:k]]


class Lists(NamedTuple):
    """An inverted file: vectors(key, embedding, list, block), the lists' centres, each list's first block, and how many it has."""

    vectors: DataFrame
    centres: np.ndarray
    first: np.ndarray
    slots: np.ndarray


def _array(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_centres(vectors: DataFrame, n_lists: int, fit_rows: int = FIT_VECTORS, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """n_lists unit vectors, or fewer if there are fewer vectors, by k-means on at most fit_rows vectors."""
    sample = vectors.select("embedding").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(fit_rows).toArrow()
    x = _unit(sample["embedding"]).astype(np.float32) if sample.num_rows else np.zeros((0, 1), np.float32)
    c = x[np.random.default_rng(seed).permutation(len(x))[:n_lists]]
    for _ in range(rounds if len(c) else 0):
        of = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.unique(np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c), axis=0)
    return c


def inverted_lists(vectors: DataFrame, n_lists: int | None = None, fit_rows: int = FIT_VECTORS) -> Lists:
    """TK4: every vector stored by its list, that of the nearest centre; neighbouring lists share a block of bounded size, long ones have several.

    The centres are fitted on a bounded sample (fit_centres), about four times as many as the root of the number of
    vectors, MOST_LISTS at most; all vectors are stored. No vectors give no lists.
    """
    n = vectors.count()
    centres = fit_centres(vectors, n_lists or int(np.clip(4 * np.sqrt(n), 1, MOST_LISTS)), fit_rows)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series((_array(v) @ centres.T).argmax(axis=1).astype(np.int32))

    stored = stage_table(vectors.select("key", "embedding", (nearest("embedding") if len(centres) else F.lit(0)).alias("list")), "lists")
    slots, first, block, room = np.ones(max(1, len(centres)), np.int64), np.zeros(max(1, len(centres)), np.int64), 0, VECTOR_BLOCK
    size = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}  # a row for each list
    for i in range(len(first)):
        rows = size.get(i, 0)
        if rows > room:
            block, room = block + (room < VECTOR_BLOCK), VECTOR_BLOCK
        first[i], slots[i] = block, max(1, -(-rows // VECTOR_BLOCK))
        block, room = (block, room - rows) if slots[i] == 1 else (block + int(slots[i]), VECTOR_BLOCK)
    places = vectors.sparkSession.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, slots, strict=True))], "list int, first int, slots int")
    placed = stored.join(F.broadcast(places), "list").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("slots"))).cast("int"))
    return Lists(placed.drop("first", "slots"), centres, first, slots)


def _list_bounds(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each unit vector and list no more than its distance from the list's vectors: that from the plane half-way to its own list's centre."""
    d = 2 - 2 * q @ centres.T
    own = d.argmin(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * centres[own] @ centres.T, 1e-12))
    return (d - d[np.arange(len(q)), own][:, None] - 1e-5) / (2 * between)  # rounding never makes it larger


def probed_lists(queries: DataFrame, lists: Lists, k: int = 12, first: int = 8, reach: float = 0.4, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(query_id, list) that a search reads beyond the `first` nearest lists, and the k nearest vectors that those hold (query_id, key, distance).

    The k-th distance there ends the search: a list is read only if its bound is at most `reach` times that distance. At
    reach 1 no list that could hold a nearer vector is left out, and the search is exact.
    """
    more, begun = _probes(queries, lists, k, first, reach, digits)
    return more.select("query_id", F.explode("lists").alias("list")), begun


def _probes(queries: DataFrame, lists: Lists, k: int, first: int, reach: float, digits: int) -> tuple[DataFrame, DataFrame]:
    """probed_lists, with a row (query_id, embedding, lists) for each query."""
    centres = lists.centres
    q = queries.select("query_id", "embedding")

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(-(_array(v) @ centres.T), axis=1, kind="stable")[:, :first].astype(np.int32)))

    @F.pandas_udf("array<int>")
    def beyond(v: pd.Series, far: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(v), ROWS):
            x, limit = _array(v.iloc[at : at + ROWS]), far.iloc[at : at + ROWS]
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :first]
            ok = _list_bounds(x, centres) <= reach * np.sqrt(2 * limit.fillna(2.0).to_numpy())[:, None] + 1e-4
            ok |= limit.isna().to_numpy()[:, None]  # fewer than k so far: all
            np.put_along_axis(ok, near, False, axis=1)
            out += [np.flatnonzero(r).astype(np.int32) for r in ok]
        return pd.Series(out)

    begun = stage_table(_search(q.withColumn("lists", nearest("embedding")), lists, k, digits), "begun")
    kth = begun.where(F.col("rank") == k).select("query_id", F.col("distance").alias("far"))
    more = q.join(kth, "query_id", "left").select("query_id", "embedding", beyond("embedding", F.col("far")).alias("lists"))
    return stage_table(more, "probes"), begun.drop("rank")


def _search(asked: DataFrame, lists: Lists, k: int, digits: int) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest in the lists asked (query_id, embedding, lists).

    A query goes once to each block of vectors that holds any of its lists, with the numbers of those, and is compared
    with the vectors of these lists alone.
    """
    first, slots = lists.first, lists.slots

    @F.pandas_udf("array<struct<block:int, lists:array<int>>>")
    def by_block(asked: pd.Series) -> pd.Series:
        out = []
        for a in asked:
            a = np.sort(np.asarray(a, np.int64))
            n = slots[a]
            of = np.repeat(a, n)
            block = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            cuts = np.flatnonzero(np.diff(block)) + 1
            out.append([{"block": int(b[0]), "lists": x} for b, x in zip(np.split(block, cuts), np.split(of, cuts), strict=True) if len(b)])
        return pd.Series(out)

    def among(left: pa.Table, right: pa.Table) -> Callable[[int], np.ndarray]:
        of = right["list"].to_numpy()
        order = np.argsort(of, kind="stable")
        of, ask = of[order], left["lists"].combine_chunks()
        ends, ask = ask.offsets.to_numpy(), ask.values.to_numpy()

        def own(i: int) -> np.ndarray:
            a = ask[ends[i] : ends[i + 1]]
            return _ranges(order, np.searchsorted(of, a), np.searchsorted(of, a, "right"))

        return own

    mine = asked.select("query_id", "embedding", F.inline(by_block("lists")))
    near = _best_of_blocks(mine, lists.vectors, ["block"], k, digits, among=among)
    w = Window.partitionBy("query_id").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ranges(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """x[begin:end] of each, one after the other."""
    n = end - begin
    return x[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]


def ivf_topk(queries: DataFrame, lists: Lists, k: int = 12, first: int = 8, reach: float = 0.4, digits: int = 6) -> DataFrame:
    """TK4: (query_id, key, rank, distance) like vector_topk, from the lists that a distance bound leaves (probed_lists)."""
    if not len(lists.centres):
        return vector_topk(queries, lists.vectors, k, digits=digits)
    more, begun = _probes(queries, lists, k, first, reach, digits)
    rest = _search(more, lists, k, digits).drop("rank")
    w = Window.partitionBy("query_id").orderBy("distance", "key")
    return begun.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "key", "rank", "distance")


def lsh_bits(rows: int) -> int:
    """Planes of a table: a bucket holds 45 to 90 of the rows on average, whatever their number."""
    return max(2, min(24, int(np.log2(max(rows, 1)) - 5.5)))


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int = 12, tables: int = 24, bits: int | None = None, probes: int = 2, dims: int = 64, seed: int = 7) -> DataFrame:
    """TK4: like vector_topk, but only among vectors that share a bucket, a side of each of `bits` planes, in one of the tables.

    Vectors are in one bucket of each table. Queries look into their own and into those beyond any of the `probes`
    planes that are nearest to them. Both meet in blocks of vectors, where a query is compared with those that share a
    bucket alone, by the exact distance; no pair of a query and a vector moves.
    bits: by default lsh_bits of the number of vectors.
    """
    bits = lsh_bits(vectors.count()) if bits is None else bits
    probes = min(probes, bits)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dims))
    offset = np.arange(tables, dtype=np.int64) << 32

    def sides(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        at = np.einsum("tbd,nd->ntb", planes, np.array(v.tolist(), float).reshape(-1, dims))
        return at, ((at > 0).astype(np.int64) << np.arange(bits)).sum(axis=2) + offset

    @F.pandas_udf("array<bigint>")
    def bucket(v: pd.Series) -> pd.Series:
        return pd.Series(list(sides(v)[1]))

    @F.pandas_udf("array<bigint>")
    def looked_into(v: pd.Series) -> pd.Series:
        at, own = sides(v)
        near = np.argsort(np.abs(at), axis=2)[:, :, :probes]
        flips = [own]
        for choice in range(1, 1 << probes):
            flips.append(own ^ sum((1 << near[:, :, j]) for j in range(probes) if choice >> j & 1))
        return pd.Series(list(np.concatenate(flips, axis=1)))

    def among(left: pa.Table, right: pa.Table) -> Callable[[int], np.ndarray]:
        theirs, mine = right["buckets"].combine_chunks(), left["buckets"].combine_chunks()
        at, looks, ends = theirs.values.to_numpy(), mine.values.to_numpy(), mine.offsets.to_numpy()
        order = np.argsort(at, kind="stable")
        at, of = at[order], np.repeat(np.arange(len(theirs)), np.diff(theirs.offsets.to_numpy()))[order]

        def own(i: int) -> np.ndarray:
            b = looks[ends[i] : ends[i + 1]]
            return np.unique(_ranges(of, np.searchsorted(at, b), np.searchsorted(at, b, "right")))

        return own

    near = _block_topk(queries.select("query_id", "embedding", looked_into("embedding").alias("buckets")), vectors.select("key", "embedding", bucket("embedding").alias("buckets")), k, 6, None, among)
    w = Window.partitionBy("query_id").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "key", "rank", "distance")

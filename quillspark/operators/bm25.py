"""Keyword retrieval: an index stored once for a state of the corpus, kept up by signed changes, and top-k that reads only lists that can matter."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokenize
from ..sources.staging import shared_dir, stage_table

#: About so many sections share a bucket; a term's sections in a bucket are one block of its list.
BUCKET = 1024
#: A task scores questions of about so many terms together with a block of about so many sections, and packs so many (question, section) pairs at a time.
QUESTION_TERMS, SECTIONS, PAIRS = 4_000_000, 16_384, 1 << 22
#: So many terms of a block at most are kept as one number for each of its sections.
WIDE = 1024
#: The first pass reads each question's rarest terms as long as their lists hold so many sections for each of the k asked for.
SEED = 40
#: Scores closer than this count as equal.
SAME = 1e-6


class Index(NamedTuple):
    """forward(key, bucket, dl, terms, tfs), blocks(term, bucket, posts, n, max_tf, min_dl), terms(term, df, idf, max_tf, min_dl) and one row of n, avgdl."""

    forward: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def forward_rows(sections: DataFrame, n_buckets: int, key: str = "key", text: str = "text") -> DataFrame:
    """(key, bucket, dl, terms, tfs): a section's different terms and how often it has each. No shuffle.

    The tokens are sorted within the row, where equal ones stand together; where they begin gives the numbers.
    """
    t = sections.select(F.col(key).alias("key"), F.sort_array(tokenize(F.col(text))).alias("s"))
    begins = F.filter(F.transform("s", lambda x, i: F.when((i == 0) | (x != F.get("s", i - 1)), i)), lambda i: i.isNotNull())
    t = t.select("key", "s", F.size("s").cast("long").alias("dl"), begins.alias("at"))
    ends = F.when(F.size("at") > 0, F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("s")))).otherwise(F.col("at"))
    return t.select("key", F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int").alias("bucket"), "dl", F.transform("at", lambda i: F.get("s", i)).alias("terms"), F.zip_with("at", ends, lambda a, b: (b - a).cast("long")).alias("tfs"))


def postings(forward: DataFrame) -> DataFrame:
    """(key, bucket, term, tf, dl): a row for each term of each section."""
    return forward.select("key", "bucket", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("key", "bucket", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "dl")


def _counts(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def _totals(forward: DataFrame) -> DataFrame:
    return forward.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))


def _blocks(forward: DataFrame) -> DataFrame:
    """A term's sections of a bucket in a row, so no list has a row of its own that grows with the corpus.

    Sections move to their bucket as they are, a row each; a task turns one bucket of about BUCKET at a time.
    """
    kinds = dict(forward.dtypes)

    def turn(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        n = np.array([0 if x is None else x for x in pa.compute.list_value_length(t["terms"]).to_pylist()], np.int64)
        words = t["terms"].combine_chunks().flatten().dictionary_encode()
        code, tf, row = words.indices.to_numpy(), t["tfs"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        order = np.argsort(code, kind="stable")
        code, tf, row = code[order], tf[order], row[order]
        begin = np.flatnonzero(np.r_[len(code) > 0, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        dl = t["dl"].to_numpy()[row]
        posts = pa.StructArray.from_arrays([t["key"].combine_chunks().take(pa.array(row)), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], ["key", "tf", "dl"])
        least = lambda f, x: pa.array(f.reduceat(x, begin) if len(begin) else np.zeros(0, np.int64), pa.int64())
        ends = np.r_[begin, len(code)]
        return pa.table({
            "term": words.dictionary.take(pa.array(code[begin])), "bucket": pa.array(np.full(len(begin), t["bucket"][0].as_py()), pa.int32()), "posts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), posts),
            "n": pa.array(np.diff(ends), pa.int64()), "max_tf": least(np.maximum, tf), "min_dl": least(np.minimum, dl),
        })

    out = f"term string, bucket int, posts array<struct<key:{kinds['key']},tf:bigint,dl:bigint>>, n bigint, max_tf bigint, min_dl bigint"
    return forward.select("key", "bucket", "dl", "terms", "tfs").groupBy("bucket").applyInArrow(turn, out)


def corpus_signature(sections: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """AG3: one row that changes when the sections do, whatever their order."""
    return sections.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.xxhash64(key).bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("keys_hash"))


def _state(sections: DataFrame, key: str, text: str) -> str:
    """The name of a state: the signature and the sections' contents."""
    content = sections.agg(F.coalesce(F.sum(F.xxhash64(key, text).bitwiseAND((1 << 40) - 1)), F.lit(0)).alias("content"))
    return "-".join(str(v) for v in corpus_signature(sections, key, text).join(content, F.lit(True), "left").first())  # one row each


class Store:
    """An index below a folder: totals, terms' counts, forward rows and blocks of postings, each a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")  # what a job that ended midway left goes
        return self.table(name)

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def index(self, eps: float = 0.25) -> Index:
        if not self.has("blocks"):
            self.put("blocks", _blocks(self.table("forward")))
        return Index(self.table("forward"), self.table("blocks"), *self.terms(eps))

    def terms(self, eps: float = 0.25) -> tuple[DataFrame, DataFrame]:
        """Terms with their idf, and one row of n, avgdl. Negative idf values become eps times the mean of all, negatives included."""
        stats = self.table("totals").select("n", (F.col("tokens") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"))
        df = self.table("counts").join(F.broadcast(stats), F.lit(True), "left")  # one row
        raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw").alias("mean"))
        idf = F.when(F.col("raw") < 0, F.col("mean") * eps).otherwise(F.col("raw"))
        return raw.join(F.broadcast(mean), F.lit(True), "left").select("term", "df", idf.alias("idf"), "max_tf", "min_dl"), stats

    def n_buckets(self) -> int:
        return self.table("totals").first()["n_buckets"]


def build_store(sections: DataFrame, path: str, key: str = "key", text: str = "text") -> Store:
    """AG1: a new store for the sections; texts are tokenised once and only counts of terms are shuffled."""
    store = Store(sections.sparkSession, path)
    n_buckets = max(1, -(-sections.count() // BUCKET))
    forward = store.put("forward", forward_rows(sections, n_buckets, key, text))
    store.put("totals", _totals(forward).withColumn("n_buckets", F.lit(n_buckets)))
    store.put("counts", _counts(postings(forward)))
    return store


def open_store(sections: DataFrame, key: str = "key", text: str = "text") -> Store:
    """The stored index of this state of the sections, built where there is none yet.

    It lies in the shared folder under the name of the state; a new one is made aside and renamed when complete, so two
    jobs that build the same never see each other's halves.
    """
    spark = sections.sparkSession
    base = shared_dir(spark)
    path = f"{base.rsplit('/', 1)[0]}/quill-bm25-{_state(sections, key, text)}"
    if not Store(spark, path).has("counts"):
        build_store(sections, base, key, text)
        here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (base, path))
        files = here.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.rename(here, there):
            files.delete(here, True)
    return Store(spark, path)


def change_store(store: Store, removed: DataFrame, added: DataFrame, path: str, key: str = "key", text: str = "text") -> Store:
    """The store after a change, below path: sections with a key of removed or added go, those of added come.

    Totals and terms' counts are the stored ones plus signed changes, which only the sections that come or go are read
    for; buckets that have none of them keep their blocks. What a term's largest tf and smallest length were stays a
    bound after deletions. The result equals a new store of the same sections but for such bounds.
    """
    new, n_buckets = Store(store.spark, path), store.n_buckets()
    keys = removed.select(F.col(key).alias("key")).unionByName(added.select(F.col(key).alias("key"))).distinct()
    forward = store.table("forward")
    come = stage_table(forward_rows(added, n_buckets, key, text), "come")
    gone = stage_table(forward.join(keys, "key", "left_semi"), "gone")
    after = new.put("forward", forward.join(keys, "key", "left_anti").unionByName(come))
    signed = lambda df, sign: df.withColumn("sign", F.lit(sign))
    totals = reduce(DataFrame.unionByName, [signed(store.table("totals").select("n", "tokens"), 1), signed(_totals(come), 1), signed(_totals(gone), -1)])
    new.put("totals", totals.agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n", "tokens")]).withColumn("n_buckets", F.lit(n_buckets)))
    counts = reduce(DataFrame.unionByName, [signed(store.table("counts"), 1), signed(_counts(postings(come)), 1), signed(_counts(postings(gone)), -1)])
    was = F.col("sign") > 0
    new.put("counts", counts.groupBy("term").agg(F.sum(F.col("df") * F.col("sign")).alias("df"), F.max(F.when(was, F.col("max_tf"))).alias("max_tf"), F.min(F.when(was, F.col("min_dl"))).alias("min_dl")).where("df > 0"))
    if store.has("blocks"):
        touched = come.select("bucket").unionByName(gone.select("bucket")).distinct()
        new.put("blocks", store.table("blocks").join(touched, "bucket", "left_anti").unionByName(_blocks(after.join(touched, "bucket", "left_semi")).select(*store.table("blocks").columns)))
    return new


def bm25_stats(sections: DataFrame, key: str = "key", text: str = "text", eps: float = 0.25) -> Index:
    """AG1: the index of the sections, from the store of their state."""
    return open_store(sections, key, text).index(eps)


def _part(tf, dl, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def _asked(queries: DataFrame, index: Index, k1: float, b: float) -> DataFrame:
    """(query_id, term, w, most, df): the terms of each question that the index has, repeated ones with the sum of their weights, and the most each can add to a score."""
    q = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    q = q.join(index.terms, "term").join(F.broadcast(index.stats), F.lit(True)).withColumn("w", F.col("idf") * F.col("qtf"))  # one row
    return q.select("query_id", "term", "w", F.greatest(F.lit(0.0), F.col("w") * _part(F.col("max_tf"), F.col("min_dl"), k1, b)).alias("most"), "df")


def _sums(index: Index, asked: DataFrame, scope: DataFrame | None, k1: float, b: float) -> DataFrame:
    """(query_id, key, part): what the asked terms (query_id, term, w) add to the score of each section in their lists."""
    s = index.blocks.select("term", "posts").join(asked.select("query_id", "term", "w"), "term").select("query_id", "w", F.inline("posts"))
    s = s.join(F.broadcast(index.stats.select("avgdl")), F.lit(True))  # one row
    s = s.groupBy("query_id", "key").agg(F.sum(F.col("w") * _part(F.col("tf"), F.col("dl"), k1, b)).alias("part"))
    return s if scope is None else s.join(scope, ["query_id", "key"], "left_semi")


def _sections(index: Index) -> int:
    """How many blocks the sections make."""
    n = index.stats.first()["n"] or 0
    return max(1, -(-n // SECTIONS), min(index.blocks.sparkSession.sparkContext.defaultParallelism, -(-n // BUCKET)))


def _score_blocks(index: Index, asked: DataFrame, k: int, scope: DataFrame | None, k1: float, b: float, most: int | None = None) -> DataFrame:
    """(query_id, key, score): the k best sections of each block of sections for each question, whole scores above 0.

    asked: (query_id, term, w, is_read, least). Only the lists of terms with is_read find sections. Where what they add
    and the others can add in this block reach the least score (the `most` best by what they add, if given), the
    question's other terms are added to those sections. Without `most`, more terms may find nothing in a
    block, by what they add there at most. Questions go to each block as a row, lists as they are stored, so what moves
    are the index and questions times blocks, never a row for a question and a posting; a question is scored by itself,
    over the sections of one block.
    """
    at_once, n_terms, sections = PAIRS, asked.count(), _sections(index)
    block, part = F.pmod("bucket", F.lit(sections)).cast("int"), F.lit(max(1, -(-n_terms // QUESTION_TERMS)))
    q = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "w", "is_read")).alias("x"), F.max("least").alias("least"))  # of one question
    q = q.select(F.pmod(F.xxhash64("query_id"), part).cast("int").alias("qb"), "query_id", *[F.col(f"x.{c}").alias(c) for c in ("term", "w", "is_read")], "least")
    q = q.join(F.broadcast(index.stats.select("avgdl")), F.lit(True))  # one row
    if scope is None:
        q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(sections - 1)))).withColumn("within", F.lit(None).cast(f"array<{dict(index.forward.dtypes)['key']}>"))
    else:
        place = index.forward.select("key", block.alias("vb"))
        q = q.join(scope.join(place, "key").groupBy("query_id", "vb").agg(F.collect_set("key").alias("within")), "query_id")  # of one block
    lists = index.blocks.join(asked.select("term").distinct(), "term", "left_semi").select("term", block.alias("vb"), "posts").withColumn("qb", F.explode(F.sequence(F.lit(0), part - 1)))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": left["query_id"].slice(0, 0), "key": pa.array([], right.schema.field("posts").type.value_type.field("key").type), "score": pa.array([], pa.float64())})]
        if not left.num_rows or not right.num_rows:
            return out[0]
        words = right["term"].combine_chunks().dictionary_encode()
        row_order = np.argsort(words.indices.to_numpy(), kind="stable")
        posts = right["posts"].combine_chunks()
        length, begins = np.diff(posts.offsets.to_numpy())[row_order], (posts.offsets.to_numpy()[:-1] - posts.offsets[0].as_py())[row_order]
        entry = np.arange(length.sum()) + np.repeat(begins - (np.cumsum(length) - length), length)  # of one term after the other
        code, keys = pd.factorize(posts.flatten().field("key").to_numpy(zero_copy_only=False)[entry])
        order = np.argsort(keys)
        nth = np.empty(len(keys), np.int64)
        nth[order] = np.arange(len(keys))
        keys, doc = keys[order], nth[code]
        tf, dl = (posts.flatten().field(c).to_numpy()[entry] for c in ("tf", "dl"))
        add = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / left["avgdl"][0].as_py()))
        begin = np.r_[0, np.cumsum(np.bincount(words.indices.to_numpy()[row_order], length, len(words.dictionary)).astype(np.int64))]
        del posts, entry, code, tf, dl

        names = left["term"].combine_chunks()
        owner = np.repeat(np.arange(left.num_rows), np.diff(names.offsets.to_numpy()))
        term = pa.compute.index_in(names.flatten(), value_set=words.dictionary).fill_null(-1).to_numpy().astype(np.int64)
        w, is_read = left["w"].combine_chunks().flatten().to_numpy(), left["is_read"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        least = np.nan_to_num(left["least"].to_numpy(), nan=0.0)
        here = term >= 0
        owner, term, w, is_read = owner[here], term[here], w[here], is_read[here]
        most_here = np.maximum(w * np.maximum.reduceat(add, begin[:-1])[term], 0.0)  # what a term adds in this block at most
        order = np.lexsort((most_here, is_read, owner))
        owner, term, w, is_read, most_here = (x[order] for x in (owner, term, w, is_read, most_here))
        first = np.searchsorted(owner, np.arange(left.num_rows + 1))
        if most is None:  # further terms that together lift nothing here to the least score find nothing
            upto = np.cumsum(most_here)
            upto -= np.r_[0.0, upto][first[owner]]
            is_read &= upto >= least[owner] - 2 * SAME
        within = left["within"].combine_chunks()
        place = pd.Index(keys) if within.null_count < len(within) else None
        wide = {}  # what the terms of most sections add, by section
        asked_here = np.unique(term)
        span = begin[asked_here + 1] - begin[asked_here]
        for i in asked_here[np.argsort(-span)[: min(WIDE, (span > len(keys) / 32).sum())]].tolist():
            wide[i] = np.zeros(len(keys))
            wide[i][doc[begin[i] : begin[i + 1]]] = add[begin[i] : begin[i + 1]]
        lo, hi, weight, bound, wides = begin[term].tolist(), begin[term + 1].tolist(), w.tolist(), most_here.tolist(), [wide.get(i) for i in term.tolist()]
        rows, found, scores = [], [], []
        score, extra = np.zeros(len(keys)), np.zeros(len(keys))

        def pack() -> None:
            n = [len(x) for x in found]
            if sum(n):
                out.append(pa.table({"query_id": left["query_id"].take(pa.array(np.repeat(rows, n))), "key": pa.array(keys[np.concatenate(found)], out[0].schema.field("key").type), "score": np.concatenate(scores)}))
            for x in (rows, found, scores):
                x.clear()

        n_found = 0
        for row in np.unique(owner[is_read]).tolist():
            terms = range(first[row], first[row + 1])
            others = [i for i in reversed(terms) if not is_read[i]]  # what can add most comes first
            rest = sum(bound[i] for i in others)
            floor = float(least[row]) - SAME
            score[:] = 0.0
            for i in terms:
                if is_read[i] and wides[i] is not None:
                    score += weight[i] * wides[i]
                elif is_read[i]:
                    score[doc[lo[i] : hi[i]]] += weight[i] * add[lo[i] : hi[i]]  # a section is once in a list
            at = np.flatnonzero(score >= floor - rest if floor > rest else score > 0)
            if within[row].is_valid:
                inside = place.get_indexer(within[row].values.to_numpy(zero_copy_only=False))
                at = np.intersect1d(at, inside[inside >= 0])
            if most and len(at) > most:
                at = np.sort(at[np.argpartition(-score[at], most - 1)[:most]])
            # the other terms of the question, at these sections alone
            whole = score.take(at)
            for i in others:
                if not len(at):
                    break
                rest -= bound[i]
                if wides[i] is None:
                    mine = doc[lo[i] : hi[i]]
                    extra[mine] = add[lo[i] : hi[i]]
                    whole += weight[i] * extra.take(at)
                    extra[mine] = 0.0
                else:
                    whole += weight[i] * wides[i].take(at)
                keep = np.flatnonzero(whole >= floor - rest)
                if len(keep) < len(at):
                    at, whole = at.take(keep), whole.take(keep)
            if len(at) and whole.min() <= 0:
                at, whole = at[whole > 0], whole[whole > 0]
            if len(at) > k:
                top = np.lexsort((at, -np.round(whole, 6)))[:k]
                at, whole = at[top], whole[top]
            if len(at):
                rows.append(row)
                found.append(at)
                scores.append(whole)
                n_found += len(at)
                if n_found >= at_once:
                    pack()
                    n_found = 0
        pack()
        return pa.concat_tables(out)

    kinds = dict(q.dtypes)["query_id"], dict(index.forward.dtypes)["key"]
    return q.groupBy("qb", "vb").cogroup(lists.groupBy("qb", "vb")).applyInArrow(best, f"query_id {kinds[0]}, key {kinds[1]}, score double")


def bm25_scores(queries: DataFrame, index: Index, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """AG2: (query_id, key, score) of all sections with a score above 0. Repeated query tokens count each."""
    return _sums(index, stage_table(_asked(queries, index, k1, b), "asked"), None, k1, b).withColumnRenamed("part", "score").where("score > 0")


def _top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "key")  # Spark cuts to k before the shuffle as well
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _needed(asked: DataFrame, least: DataFrame) -> DataFrame:
    """asked with is_needed.

    The terms with the smallest most, as long as together they stay below the least score, lift no section there alone:
    whatever reaches it has one of the others.
    """
    order = Window.partitionBy("query_id").orderBy("most", "term")
    return asked.join(least, "query_id", "left").withColumn("upto", F.sum("most").over(order)).withColumn("is_needed", F.col("upto") >= F.coalesce("least", F.lit(0.0)) - SAME)


def _plan(queries: DataFrame, index: Index, k: int, scope: DataFrame | None, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """The questions' terms as _needed has them, and which of them the first pass read."""
    asked = stage_table(_asked(queries, index, k1, b), "asked")
    rare = Window.partitionBy("query_id").orderBy("df", "term")
    seeds = asked.withColumn("upto", F.sum("df").over(rare)).where((F.col("upto") - F.col("df") < k * SEED) & (F.col("w") > 0))
    seeds = seeds.withColumn("first", F.row_number().over(rare)).where((F.col("upto") <= 4 * k * SEED) | (F.col("first") == 1)).drop("upto", "first")
    read = asked.join(seeds.select("query_id", "term", F.lit(True).alias("is_read")), ["query_id", "term"], "left").withColumns({"is_read": F.coalesce("is_read", F.lit(False)), "least": F.lit(0.0)})
    each = min(k, max(4, -(-4 * k // _sections(index))))  # of each block: the k-th of any sections' scores is a bound, a lower one at worst
    first = _score_blocks(index, stage_table(read, "seeds"), each, scope, k1, b, most=2 * each)
    least = _top(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    return stage_table(_needed(asked, least), "needed"), seeds


def _pruned(queries: DataFrame, index: Index, k: int, scope: DataFrame | None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The scores of all sections that can be among the k best of a question, in two passes.

    The first scores what the rarest terms of a question find; its k-th score is the least that others have to reach.
    Lists of terms that can't lift a section there, the longest ones mostly, find none any more (_needed); a section
    from the other lists is scored whole, in its block, if what it has so far and what the rest can add there reach the least.
    """
    asked, _ = _plan(queries, index, k, scope, k1, b)
    return _score_blocks(index, asked.withColumnRenamed("is_needed", "is_read"), k, scope, k1, b)


def bm25_read_share(queries: DataFrame, index: Index, k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, n_postings, n_read): the lengths of a question's lists and how much of them bm25_topk reads, in both passes."""
    asked, seeds = _plan(queries, index, k, None, k1, b)
    first = seeds.groupBy("query_id").agg(F.sum("df").alias("n_first"))
    a = asked.groupBy("query_id").agg(F.sum("df").alias("n_postings"), F.sum(F.when(F.col("is_needed"), F.col("df")).otherwise(0)).alias("n_second"))
    return a.join(first, "query_id", "left").select("query_id", "n_postings", (F.coalesce("n_first", F.lit(0)) + F.col("n_second")).alias("n_read"))


def bm25_topk(queries: DataFrame, index: Index, k: int = 20, scope: DataFrame | None = None, scope_first: bool = True) -> DataFrame:
    """TK1, TK2, TK5: (query_id, key, rank, score). A scope, rows (query_id, key), is applied before the cut or after.

    Statistics stay those of the whole corpus either way. Equal scores are ordered by key.
    """
    top = _top(_pruned(queries, index, k, scope if scope_first else None), k)
    if scope is not None and not scope_first:
        top = top.join(scope, ["query_id", "key"], "left_semi")
    return top.select("query_id", "key", "rank", "score")

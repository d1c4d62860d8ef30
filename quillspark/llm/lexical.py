"""Ranked lexical search: bit-sliced Bloom signatures bound every document's score from above, and what they can't exclude is scored exactly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import maybe_among, partitions, stage_table

#: Letters, digits and all beyond ASCII; only A-Z become lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every other byte separates terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: A term is entered once for each of these frequencies that it reaches, so a signature bounds how often it occurs.
LEVELS = (1, 2, 3, 4, 6, 9, 14, 21, 32, 64, 128, 256, 1024, 4096, 1 << 16, 1 << 20)
#: Bits of a signature for each entry at least, set bits of an entry, and bits of a block of signatures, one slice a bit.
BITS, HASHES, BLOCK = 12, 3, 1 << 22
#: Questions are dealt into blocks of about so many terms; a task that meets a block keeps the best of its questions alone.
QUESTION_TERMS = 4096
#: So many texts are scored beside one copy of a block of questions.
SCORED = 512
_CHUNK = 512
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_CACHE = 500_000


def words_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _terms(c) -> F.Column:
    return F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def places(hashes: np.ndarray, level: np.ndarray | int, log_width: int) -> np.ndarray:
    """The HASHES slices, a row each, that an entry (term hash, number of the level) sets in signatures of that width."""
    with np.errstate(over="ignore"):
        h = (hashes ^ (np.asarray(level, np.uint64) * _MIX[3])) * _MIX[0]
        h ^= h >> np.uint64(29)
        return np.stack([(h * _MIX[k]) >> np.uint64(64 - log_width) for k in range(HASHES)]).astype(np.int64)


class Index(NamedTuple):
    """blocks (log_width, ids, hashes, n, slices, terms, dfs) and one row of stats (n_docs, total)."""

    blocks: DataFrame
    stats: DataFrame


def signature_index(docs: DataFrame, name: str = "doc_id", text: str = "text") -> Index:
    """The signatures of all documents in one pass over their texts, without a shuffle.

    Documents of a task whose signatures have the same width, a power of two that follows the number of their entries,
    stand together in a block: slice i has a bit for each of them that says whether its signature has bit i. Rows also
    hold the documents' ids, text hashes and lengths. With its last rows a task gives the document frequencies it has
    counted. Documents are rows: repeated ones count as often as they come; texts without terms count in nothing.
    """
    levels = np.array(LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        df: Counter[bytes] = Counter()
        open_: dict[int, list[tuple]] = {}

        def row(log_width: int, docs: list[tuple], terms: list[bytes], dfs: list[int]) -> pa.RecordBatch:
            slices = b""
            if docs:
                bits = np.zeros((1 << log_width, -(-len(docs) // 8) * 8), bool)
                for r, d in enumerate(docs):
                    bits[d[3], r] = True
                slices = np.packbits(bits, axis=1).tobytes()
            cols = [pa.array([log_width], pa.int32()), *(pa.array([[d[k] for d in docs]], pa.list_(pa.int64())) for k in range(3)), pa.array([slices], pa.binary()), pa.array([terms], pa.list_(pa.binary())), pa.array([dfs], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["log_width", "ids", "hashes", "n", "slices", "terms", "dfs"])

        def frequencies() -> Iterator[pa.RecordBatch]:
            pairs = list(df.items())
            df.clear()
            for at in range(0, len(pairs), 100_000):
                yield row(0, [], *map(list, zip(*pairs[at : at + 100_000], strict=True)))

        for b in batches:
            for i, h, t in zip(*(b.column(c).to_pylist() for c in ("lex_id", "lex_h")), b.column("lex_text"), strict=True):
                tf = Counter(words_of(t.as_py()))
                if not tf:
                    continue
                df.update(tf.keys())
                if len(known) > _CACHE:
                    known.clear()
                for w in tf:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w)
                hashes = np.fromiter(map(known.__getitem__, tf), np.uint64, len(tf))
                times = np.fromiter(tf.values(), np.int64, len(tf))
                reached = np.searchsorted(levels, times, "right")
                n = int(reached.sum())
                log_width = max(6, (BITS * n - 1).bit_length())
                level = np.arange(n) - np.repeat(np.cumsum(reached) - reached, reached)
                own = open_.setdefault(log_width, [])
                own.append((i, h, int(times.sum()), np.unique(places(np.repeat(hashes, reached), level, log_width))))
                if len(own) >= max(8, BLOCK >> log_width):
                    yield row(log_width, open_.pop(log_width), [], [])
            if len(df) > _CACHE:
                yield from frequencies()
        for log_width, own in open_.items():
            yield row(log_width, own, [], [])
        yield from frequencies()

    rows = docs.select(F.col(name).cast("long").alias("lex_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("lex_h"), F.col(text).alias("lex_text"))
    blocks = stage_table(rows.mapInArrow(run, "log_width int, ids array<bigint>, hashes array<bigint>, n array<bigint>, slices binary, terms array<binary>, dfs array<bigint>"), "slices")
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    return Index(blocks, blocks.agg(F.coalesce(F.sum(F.size("n")), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(total), F.lit(0)).alias("total")))


def _question_blocks(terms: DataFrame, n: int) -> DataFrame:
    """(qb, questions): about QUESTION_TERMS terms a block; a question is one row of it, whatever its length."""
    one = terms.groupBy("qid").agg(F.collect_list(F.struct("term", "qtf", "w")).alias("terms"), F.max("least").alias("least"))  # of one question
    dealt = one.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-n // QUESTION_TERMS)))).cast("int"))
    return dealt.groupBy("qb").agg(F.collect_list(F.struct("qid", "least", "terms")).alias("questions"))


def _bounds(index: Index, questions: DataFrame, keep: int | None) -> DataFrame:
    """(qid, id, h, bound): documents whose upper bound reaches the question's least score; with keep so many of the best for each task and question.

    Blocks of signatures meet blocks of questions by an equality join over salts, so no block has a task of its own.
    A block's terms are looked up together: of the slices that a term sets the common bits are the documents that may
    have it, level by level of its frequency, which bounds its part of the score; the parts of its terms, summed up over
    the block, bound a question's scores.
    """
    spark = index.blocks.sparkSession
    n = partitions(spark)
    n_qb = questions.agg(F.coalesce(F.max("qb") + 1, F.lit(0))).first()[0]
    theirs = questions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    mine = index.blocks.where("log_width > 0").select("log_width", "ids", "hashes", "n", "slices").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int"))
    mine = mine.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(n_qb, 1) - 1)))).join(F.broadcast(index.stats), F.lit(True), "left")  # one row
    ceilings = np.array([*(x - 1 for x in LEVELS[1:]), 1 << 40], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        now, asked = None, None

        def out(rows: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
            qid = np.repeat(np.fromiter(rows, np.int64, len(rows)), [len(r[0]) for r in rows.values()])
            cols = [np.concatenate([r[k] for r in rows.values()]) if rows else np.empty(0, np.int64) for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(cols[0], pa.int64(), mask=cols[3] > 0), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["qid", "id", "h", "bound"])

        for b in batches:
            for r in range(b.num_rows):
                qb = b.column("qb")[r].as_py()
                if qb != now:
                    if best:
                        yield out(best)
                    now, asked, best = qb, _Asked(b.column("questions")[r].as_py()), {}
                ids = b.column("ids").slice(r, 1).flatten()
                block = [np.asarray(ids.fill_null(0)), b.column("hashes").slice(r, 1).flatten().to_numpy(), np.asarray(ids.is_null()).astype(np.int64)]
                n = b.column("n").slice(r, 1).flatten().to_numpy()
                m = 75 + 25 * n * b.column("n_docs")[r].as_py() // b.column("total")[r].as_py()
                slices = np.frombuffer(b.column("slices")[r].as_buffer(), np.uint8).reshape(1 << b.column("log_width")[r].as_py(), -1)
                found: dict[int, list[np.ndarray]] = {}
                for q, sums in asked.sums(slices, n, m, ceilings):
                    at = np.flatnonzero(sums >= asked.least[q])
                    if keep and len(at) > keep:
                        at = at[np.argpartition(sums[at], len(at) - keep)[-keep:]]
                    if len(at):
                        found[asked.qid[q]] = [block[0][at], block[1][at], sums[at], block[2][at]]
                if keep:
                    for qid, rows in found.items():
                        if qid in best:
                            rows = [np.concatenate(x) for x in zip(best[qid], rows, strict=True)]
                            if len(rows[0]) > keep:
                                top = np.argpartition(rows[2], len(rows[0]) - keep)[-keep:]
                                rows = [x[top] for x in rows]
                        best[qid] = rows
                elif found:
                    yield out(found)
        if best:
            yield out(best)

    met = mine.join(theirs, ["qb", "salt"])
    return met.select("qb", "questions", "log_width", "ids", "hashes", "n", "slices", "n_docs", "total").mapInArrow(run, "qid bigint, id bigint, h bigint, bound bigint")


class _Asked:
    """A block of questions: its different terms with their hashes and weights, and each question's terms."""

    def __init__(self, questions: list[dict]):
        self.qid = [q["qid"] for q in questions]
        self.least = [q["least"] for q in questions]
        at: dict[bytes, int] = {}
        weight: list[int] = []
        self.parts = []
        for q in questions:
            own = []
            for t in q["terms"]:
                if t["term"] not in at:
                    at[t["term"]] = len(at)
                    weight.append(t["w"])
                own.append((at[t["term"]], t["qtf"]))
            self.parts.append((np.array([x for x, _ in own]), np.array([x for _, x in own], np.int64)))
        self.terms = at
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in at], np.uint64)
        self.weight = np.array(weight, np.int64)

    def sums(self, slices: np.ndarray, n: np.ndarray, m: np.ndarray, ceilings: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The number of each question and the bounds of the block's documents."""
        width = slices.shape[0].bit_length() - 1
        total = np.zeros((len(self.qid), len(n)), np.int64)
        for start in range(0, len(self.hashes), _CHUNK):
            part = slice(start, start + _CHUNK)
            bounds = self._parts(self.hashes[part], self.weight[part], slices, width, n, m, ceilings)
            for q, (at, times) in enumerate(self.parts):
                own = (at >= start) & (at < start + _CHUNK)
                if own.any():
                    total[q] += times[own] @ bounds[at[own] - start]
        return enumerate(total)

    @staticmethod
    def _parts(hashes: np.ndarray, weight: np.ndarray, slices: np.ndarray, width: int, n: np.ndarray, m: np.ndarray, ceilings: np.ndarray) -> np.ndarray:
        """The most that each term may add to each document's score."""
        out = np.zeros((len(hashes), len(n)), np.int64)
        active, seen = np.arange(len(hashes)), None
        for level, ceiling in enumerate(ceilings):
            at = places(hashes[active], level, width)
            bits = slices[at[0]] & slices[at[1]] & slices[at[2]]
            if seen is not None:
                bits &= seen
            some = bits.any(axis=1)
            active, seen = active[some], bits[some]
            if not len(active):
                break
            t, d = np.nonzero(np.unpackbits(seen, axis=1, count=len(n)))
            tf = np.minimum(ceiling, n[d])
            out[active[t], d] = weight[active[t]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[d]))
        return out


def _exact(docs: DataFrame, candidates: DataFrame, questions: DataFrame, stats: DataFrame, k: int, name: str, text: str) -> DataFrame:
    """(qid, id, h, no, score) of candidates (qid, id, h): of what a task scores the k best of a question, a row for each row of docs.

    A bitmap keeps the texts of other documents from moving; the join on id and text hash that follows is exact. A text
    moves once for each block of questions that it is a candidate of, with the numbers of the questions, and about
    SCORED texts meet a copy of the block in a task, so no row is made for a document's terms.
    """
    in_block = questions.select("qb", F.explode("questions.qid").alias("qid"))
    named = candidates.join(in_block, "qid").groupBy("qb", "id", "h").agg(F.collect_set("qid").alias("qids"))  # of one block
    named = stage_table(named, "named").withColumnsRenamed({"id": "c_id", "h": "c_h"})
    n = max(1, -(-named.count() // SCORED))
    own = docs.select(F.col(name).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("text"))
    on = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h"))
    own = maybe_among(own, "h", candidates).join(named.select("c_id", "c_h").distinct(), on, "left_semi")
    own = own.groupBy("id", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows"))
    own = own.join(named, on).join(F.broadcast(stats), F.lit(True))  # one row
    own = own.select("qb", F.pmod(F.xxhash64("h", "id"), F.lit(n)).cast("int").alias("salt"), "id", "h", "rows", "text", "qids", "n_docs", "total")
    theirs = questions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[int, list[tuple]] = {}
        if len(left) and len(right):
            asked = _Asked(right["questions"][0].as_py())
            number = {q: i for i, q in enumerate(asked.qid)}
            for r in range(len(left)):
                get = lambda c: left[c][r].as_py()  # noqa: B023, E731
                tf = Counter(words_of(get("text")))
                n = sum(tf.values())
                m = 75 + 25 * n * get("n_docs") // get("total")
                adds = np.zeros(len(asked.terms), np.int64)
                at, times = np.array([(asked.terms[w], t) for w, t in tf.items() if w in asked.terms], np.int64).reshape(-1, 2).T
                adds[at] = asked.weight[at] * ((1_000_000_000 * times) // (1000 * times + 12 * m))
                for q in get("qids"):
                    own, asks = asked.parts[number[q]]
                    if (s := int(asks @ adds[own])) > 0:
                        i = get("id")
                        best = rows.setdefault(q, [])
                        best.append((-s, i is None, i or 0, get("h"), get("rows")))
                        if len(best) >= 4 * k + 64:
                            best.sort()
                            del best[k:]
        flat = [(q, None if x[1] else x[2], x[3], x[4], -x[0]) for q, best in rows.items() for x in sorted(best)[:k]]
        return pa.table({c: pa.array([x[j] for x in flat], pa.int64()) for j, c in enumerate(("qid", "id", "h", "rows", "score"))})

    met = own.groupBy("qb", "salt").cogroup(theirs.groupBy("qb", "salt"))
    scored = met.applyInArrow(score, "qid bigint, id bigint, h bigint, rows bigint, score bigint")
    return scored.select("qid", "id", "h", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("no"))


def lexical_topk(docs: DataFrame, questions: DataFrame, k: int = 20, index: Index | None = None, name: str = "doc_id", text: str = "text") -> DataFrame:
    """(qid, rank, doc_id, score): for each question (qid long, text) the k documents of the highest score above 0.

    A term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and a document's m 75 + (25 * n * N) div L, where N
    counts the documents with a term, L all their terms, n the document's own and df the documents that have the term;
    a score sums weight * ((1000000000 * tf) div (1000 * tf + 12 * m)) over the question's terms, repeats included, in
    whole numbers. Equal scores go by ascending doc_id, null last.

    The k best of each question by signature bounds alone are scored exactly; the k-th score is the least that the others
    have to reach, and every document whose bound reaches it is scored exactly in the end. Nothing is cut that the bounds
    don't exclude. Null and empty texts have no terms: as documents they are in no result and in no statistic, as
    questions they find nothing. Rows of docs that repeat id and text get a rank each. Extra columns are not read.
    """
    index = index or signature_index(docs, name, text)
    stats = stage_table(index.stats, "stats")
    asked = questions.select("qid", F.explode(_terms(F.col("text"))).alias("term")).groupBy("qid", F.col("term").cast("binary").alias("term")).agg(F.count(F.lit(1)).alias("qtf"))
    asked = stage_table(asked, "asked")
    counted = index.blocks.where("log_width = 0").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    counted = counted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.col("n_docs") + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = asked.join(counted, "term").join(F.broadcast(stats), F.lit(True)).select("qid", "term", "qtf", weight.alias("w")).where("w > 0")  # one row
    terms = stage_table(terms, "terms")
    n = terms.count()
    best = Window.partitionBy("qid").orderBy(F.desc("bound"), "h")
    any_score = _question_blocks(terms.withColumn("least", F.lit(1).cast("long")), n)
    first = _bounds(index, any_score, k)
    first = stage_table(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "id", "h"), "first")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "h", "no")
    ranked = _exact(docs, first, any_score, stats, k, name, text).withColumn("rank", F.row_number().over(order))
    least = stage_table(ranked.where(F.col("rank") == k).select("qid", F.col("score").alias("least")), "least")
    bounded = _question_blocks(terms.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))), n)
    left = stage_table(_bounds(index, bounded, None).select("qid", "id", "h"), "left")
    ranked = _exact(docs, left, any_score, stats, k, name, text).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", F.col("id").alias("doc_id"), "score")

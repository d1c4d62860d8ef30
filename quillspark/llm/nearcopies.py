"""Near copies by SimHash candidates: shared one-wildcard signatures propose pairs, whole shingle sets decide by their Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, drop_staged, maybe_among, spare_names, stage_table
from .simhash import shared_only, signatures, word_shingles

#: Independent fingerprints of a text's different words, two segments of 32 bits each; sets that share a signature of any are candidates.
TABLES = 4
#: All pairs of a key are compared where it has at most so many sets, or so many outside its largest component.
SMALL = 64
#: Sets of a key that each other set is compared with at once.
HUBS = 4
KEYS = ["sim_id", "sim_no", "sim_h"]
PRINTS = 1 << 12
#: Slots in which shingles are counted; what is sent to tasks is one number for each.
SLOTS = 1 << 16
#: Bits of a set's parity map: what it holds an odd number of is set, so two maps differ in no more bits than their sets in shingles.
PARITY = 1024


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in set(word_shingles(text, shingle_words))), np.uint64))


@cache
def _odd(tables: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, (tables, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def word_prints(text: str | None, tables: int) -> list[int]:
    """`tables` SimHashes, as signed longs, of the different words of a text; zeros without words."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return [0] * tables
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    odd = _odd(tables)
    ones = np.zeros((tables, 64), np.int64)
    for at in range(0, len(h), PRINTS):  # bounded memory for very long texts
        x = h[None, at : at + PRINTS] * odd
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(tables, -1, 8), axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1).view(">i8")[:, 0].tolist()


def parity_map(h: np.ndarray) -> list[int]:
    """PARITY bits, as signed longs, of a set of hashes."""
    return np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1).view(">i8").tolist()


def _prints(docs: DataFrame, shingle_words: int, tables: int) -> DataFrame:
    """KEYS, the node (one for all texts of one shingle set), the set's size, its parity map and the fingerprints. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, bits, fps = [], [], [], []
            for t in b.column("text"):
                text = t.as_py()
                h = shingle_set(text, shingle_words)
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                size.append(len(h))
                bits.append(parity_map(h))
                fps.append(word_prints(text, tables))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEYS), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(fps, pa.list_(pa.int64()))], names=[*KEYS, "node", "size", "bits", "fps"])

    return docs.select(*KEYS, "text").mapInArrow(run, "sim_id bigint, sim_no boolean, sim_h bigint, node bigint, size int, bits array<bigint>, fps array<bigint>")


def _sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(node, hashes): the different shingles of the texts as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, n in zip(b.column("text"), b.column("node"), strict=True):  # a row each: sets are as large as texts
                yield pa.RecordBatch.from_arrays([pa.array([n.as_py()], pa.int64()), pa.array([shingle_set(t.as_py(), shingle_words).view(np.int64)], pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, hashes array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have that similarity."""
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p = p.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return p.where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def rare_shingles(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, pos, node, size, bits): for each node the rarest of its shingles, so many that any two sets of that similarity share one.

    Shingles stand in one order for all, by how often the nodes have those of their slot, one of SLOTS that hashes are
    dealt to: any order that is the same for all sets is exact, and this one is looked up within a set's row. Of a set of
    n, all but the last similarity * n, rounded up, and one more are taken, with their places in that order, from 0. What
    has a slot alone is in one set alone; it gives no key but fills its place.
    """
    s = stage_table(nodes.select("node", "bits").join(sets, "node"), "rare_sets")
    slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
    each = s.select(F.explode(F.transform("hashes", slot)).alias("slot"), F.lit(1).alias("n")).unionByName(nodes.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("n")))
    tally = each.groupBy("slot").agg(F.sum("n").cast("int").alias("n")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "n"))), lambda x: x["n"]).alias("tally"))
    tally = stage_table(tally, "tally")  # one row of SLOTS numbers
    size = F.size("hashes")
    line = F.sort_array(F.transform("hashes", lambda h: F.struct(F.get("tally", slot(h)).alias("n"), h.alias("key"))))
    first = F.slice(line, F.lit(1), size - F.ceil(size * similarity - 1e-9).cast("int") + 1)
    placed = F.filter(F.transform(first, lambda x, i: F.struct(x["n"].alias("n"), x["key"].alias("key"), i.alias("pos"))), lambda x: x["n"] > 1)
    return s.join(F.broadcast(tally)).select("node", size.alias("size"), "bits", F.explode(placed).alias("x")).select("x.key", "x.pos", "node", "size", "bits")


def _may_fit(similarity: float, x, y):
    """Whether two members can have that similarity: no pair that has it fails, and no set is needed.

    Of n and m shingles they then share s / (1 + s) * (n + m) at least. Where the first that they share stands at places
    i and j of the common order, they share n - i and m - j at most; that holds for one of the keys of a pair. All others
    are in one set alone, and the parity maps differ in as many bits at most. x and y give a member's columns by name.
    """
    total = (x("size") + y("size")).cast("double")
    shared = F.least(x("size") - x("pos"), y("size") - y("pos"))
    differ = F.aggregate(F.zip_with(x("bits"), y("bits"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    return (shared >= similarity / (1 + similarity) * total - 1e-6) & (differ <= (1 - similarity) / (1 + similarity) * total + 1e-6)


_MEMBER = ["node", "size", "pos", "bits"]


def _hub_links(members: DataFrame, sets: DataFrame, similarity: float, hubs: int, of: str = "true") -> DataFrame:
    """Links of each set, `of` those for which that holds, with `hubs` sets of its key, chosen by hash, that are not known to belong with it."""
    one = lambda t: F.min(F.struct(F.xxhash64("node", F.lit(t)).alias("at"), "part", *_MEMBER))
    chosen = members.groupBy("key").agg(F.array(*[one(t) for t in range(hubs)]).alias("hubs"))
    # hubs that can't fit go within the row, before anything is made of them
    fit = F.filter("hubs", lambda h: (F.col("part") != h["part"]) & _may_fit(similarity, F.col, lambda c: h[c]))
    pairs = members.where(of).join(chosen, "key").select(F.col("node").alias("a"), F.explode(F.transform(fit, lambda h: h["node"])).alias("b"))
    return stage_table(_confirmed(pairs, sets, similarity), "links")


def _all_links(left: DataFrame, right: DataFrame, sets: DataFrame, similarity: float, once: str = "true") -> DataFrame:
    """Links of every set of left with all sets of its key in right that are not known to belong with it; `once` may name l's and r's columns."""
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.part") != F.col("r.part")) & F.expr(once) & _may_fit(similarity, lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"))
    pairs = left.alias("l").join(right.alias("r"), on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    return stage_table(_confirmed(pairs, sets, similarity), "links")


def _parted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of nodes with the node's component so far, part."""
    return nodes.join(connected_components(links), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def _open(m: DataFrame) -> DataFrame:
    """The members of keys that have more than one component.

    main is the key's largest component, and n_out says how many of its sets are outside that one.
    """
    of = m.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), (F.sum("n") - F.max("n")).alias("n_out")).where("n_out > 0")
    return stage_table(m.join(of, "key"), "open")


def set_links(members: DataFrame, sets: DataFrame, similarity: float, nodes: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect all nodes of members (key, node) which share a key and have that similarity.

    First each set is compared with one set, the hub, of the key that it shares with most others: a row for each set, not
    for each of its keys. After that only pairs in different components matter: all of a key's, where it has at most SMALL
    sets or at most SMALL are outside its largest component. What is left of crowded keys is dealt anew by the rarest
    shingles, which any two similar sets share; there those outside their key's largest component are compared with HUBS
    more, and then all in different components. What sizes, places and parity maps exclude (_may_fit) goes before any set
    moves; nodes has size and bits. Where it is not given, members has the size, and no map excludes anything; members
    may lack n, the sets of their key, which is then counted. No similar pair of a key is left out, and the number of
    rounds is fixed.
    """
    if nodes is None:
        nodes = members.select("node", "size", F.array().cast("array<bigint>").alias("bits")).distinct()
    if "n" not in members.columns:
        members = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    members = members.select("key", "node", "n")
    most = members.groupBy("node").agg(F.max(F.struct("n", "key"))["key"].alias("key")).join(nodes.withColumn("pos", F.lit(0)), "node")
    links = _hub_links(most.withColumn("part", F.col("node")), sets, similarity, 1)
    parts = stage_table(members.join(_parted(nodes.withColumn("pos", F.lit(0)), links), "node"), "parts")
    few = parts.where(f"n <= {SMALL}")
    links = links.unionByName(_all_links(few, few, sets, similarity, "l.node < r.node"))
    m = _open(parts.where(f"n > {SMALL}"))
    links = links.unionByName(_all_links(m.where(f"n_out <= {SMALL} and part <> main"), m, sets, similarity))
    crowded = m.where(f"n_out > {SMALL}").select("node", "bits").distinct()
    if crowded.isEmpty():
        return links
    again = rare_shingles(crowded, sets, similarity)
    shared = again.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rare = stage_table(again.join(shared, "key"), "rare")
    m = _open(stage_table(_parted(rare, links), "parts"))
    links = links.unionByName(_hub_links(m, sets, similarity, HUBS, "part <> main"))
    m = _open(stage_table(_parted(m.drop("part", "main", "n_out"), links), "parts"))
    return links.unionByName(_all_links(m.where("part <> main"), m, sets, similarity))


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, tables: int = TABLES) -> DataFrame:
    """docs without all but one document of each group linked by shingle sets of that Jaccard similarity or more.

    Candidates share a one-wildcard signature of one of `tables` SimHashes of their words. The document with the
    smallest doc_id stays. Rows that repeat the kept doc_id and text are one document and stay once. A group without
    any doc_id keeps the text with the smallest hash. Texts without words, null or empty, are one group. An empty table
    stays empty. All columns of docs stay.
    """
    mine = spare_names(docs, *KEYS)
    h, no = F.xxhash64(F.coalesce("text", F.lit(""))), F.col("doc_id").isNull()
    named = docs.withColumns(dict(zip(mine, [F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62)), no, h], strict=True)))
    keyed = named.select(*[F.col(m).alias(k) for m, k in zip(mine, KEYS, strict=True)], "text")
    rows = stage_table(_prints(keyed, shingle_words, tables), "prints")
    reps = stage_table(rows.groupBy("node").agg(F.min(F.struct(*KEYS)).alias("x"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fps").alias("fps")), "nodes")
    prints = reps.where("size > 0").select("node", F.posexplode("fps").alias("table", "fp"))
    shared = stage_table(shared_only(signatures(prints, 3).drop("fp")).select(F.col("sig").alias("key"), "node", "n"), "shared")
    asked = stage_table(reps.join(shared.select("node").distinct(), "node").select("node", "size", "bits", "x.*"), "asked")
    texts = maybe_among(keyed, "sim_h", asked).join(asked.select("node", *KEYS).hint("merge"), KEYS)  # the same join at every size
    sets = stage_table(_sets(texts, shingle_words).dropDuplicates(["node"]), "sets")
    comp = connected_components(set_links(shared, sets, similarity, asked.select("node", "size", "bits")))
    low = reps.select("node", "x").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keep = stage_table(low.groupBy("component").agg(F.min("x").alias("x")).select("x.*").toDF(*mine), "keep")
    for table in (rows, reps, shared, asked, sets):
        drop_staged(table)
    return named.join(keep, mine, "left_semi").dropDuplicates(mine).select(*docs.columns)

"""SimHash near-duplicates: deletion-variant signatures, equality joins, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, partitions, spare_names, stage_table

#: Signatures with more fingerprints than SMALL are looked at more closely: their fingerprints are first linked through
#: shared neighbours. Those with more than LARGE are linked only that way, without comparing pairs.
SMALL, LARGE = 64, 2048


def word_shingles(text: str | None, shingle_words: int) -> list[bytes]:
    """The word shingles of a text in order; one of all words if there are no more than shingle_words, none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if len(w) <= shingle_words:
        return [b" ".join(w)] if w else []
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = shingle_words - 1
    return [line[a:b] for a, b in zip(starts[:-k].tolist() if k else starts.tolist(), ends[k:].tolist(), strict=True)]


def fingerprint_bytes(text: str | None, shingle_words: int, seeds: list[int]) -> list[int]:
    """One 64-bit SimHash for each seed, as signed longs, of the word shingles of a text, repeats included."""
    shingles = word_shingles(text, shingle_words)
    if not shingles:
        return [0] * len(seeds)
    out = []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        digest = xxhash.xxh64_intdigest
        for at in range(0, len(shingles), 1 << 16):  # bounded memory for very long texts
            part = shingles[at : at + (1 << 16)]
            h = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(shingles)).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, keys: list[str], shingle_words: int = 5, tables: int = 1, seed: int = 42, text: str = "text") -> DataFrame:
    """keys and `fps`, an array of one SimHash for each of `tables` seeds. No shuffle; texts are read whole."""
    seeds = list(range(seed, seed + tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_bytes(t.as_py(), shingle_words, seeds) for t in b.column("simhash_text")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(fps, pa.list_(pa.int64()))], names=[*keys, "fps"])

    rows = docs.select(*keys, F.col(text).alias("simhash_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, fps array<bigint>")


def signatures(fps: DataFrame, max_bits: int) -> DataFrame:
    """(sig, wild, node and what else fps has): the fingerprint cut into max_bits // 2 + 1 segments (two at least), of which one differs by at most a bit.

    A segment gives one signature for each choice of a wildcard bit. A wildcard reads as clear, so all choices of a bit
    that is clear are the segment itself, and half as many signatures remain as there are bits. Two fingerprints within
    max_bits share a signature: of two segments that differ in one bit, the one that has it set names the other. wild
    has one bit set: the lowest for the segment itself, else that after the wildcard.
    """
    n = max(2, max_bits // 2 + 1)
    at = [64 * i // n for i in range(n + 1)]
    keys = []
    for s, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        seg = F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1)
        # segments have 32 bits at most, so table, segment and what is left of it fit a long
        name = lambda v, i, s=s: F.struct(((F.col("table") * 64 + s) * (1 << 32) + v).alias("sig"), F.lit(1 << i).cast("long").alias("wild"))
        keys.append(name(seg, 0))
        keys += [F.when(seg.bitwiseAND(1 << i) != 0, name(seg - (1 << i), i + 1)) for i in range(b - a)]
    rest = [c for c in fps.columns if c != "table"]
    return fps.select(F.explode(F.array(*keys)).alias("x"), *rest).where("x is not null").select("x.sig", "x.wild", *rest)


def _ball(fp, radius: int) -> F.Column:
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return F.explode(F.transform(F.lit(np.array(masks, np.uint64).view(np.int64)), lambda m: fp.bitwiseXOR(m)))


def neighbour_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) that connect exactly what is within max_bits, found without pairs: linear in the fingerprints.

    Every fingerprint names the points within max_bits // 2 of itself (near) and those within the rest (far). All that
    name a point which some fingerprint is near to are connected through that one: by the triangle inequality each is
    within max_bits of it, and two fingerprints within max_bits have such a point on the way between them.
    """
    near = max_bits // 2
    spread = fps.repartition(partitions(fps.sparkSession), "node", "table")
    z = spread.select("table", "node", "fp", _ball(F.col("fp"), max_bits - near).alias("z"))
    z = z.select("table", "z", "node", (F.bit_count(F.col("z").bitwiseXOR(F.col("fp"))) <= near).alias("is_near"))
    hub = z.groupBy("table", "z").agg(F.min(F.when(F.col("is_near"), F.col("node"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("hub is not null and n > 1")
    return z.join(hub, ["table", "z"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def shared_only(sig: DataFrame) -> DataFrame:
    """The rows of sig whose signature tells something, with their number n.

    These are segments that several fingerprints have, and signatures that different segments share. What only equal
    segments share is left out: they share the segment. Counts are summed before they move.
    """
    count = sig.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.bit_or("wild").alias("wilds")).where("n > 1 and (wilds = 1 or bit_count(wilds) > 1)")
    count = stage_table(count.drop("wilds"), "signatures")
    return sig.drop("wild").join(count.hint("merge"), "sig")  # the same join at every size


def fingerprint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) between nodes such that components equal those of `any table's fingerprints within max_bits`.

    fps: table int, node long, fp long, distinct. Signatures shared by at most SMALL fingerprints give the pairs that an
    equality join finds and the distance confirms. Fingerprints that share crowded signatures are first connected where
    they differ by two bits at most, through common neighbours; after that only pairs in different components are
    emitted, and signatures with more than LARGE fingerprints go through neighbour_links, which makes no pairs.
    """
    fps = stage_table(fps.repartition(partitions(fps.sparkSession), "node"), "fps")
    sig = signatures(fps, max_bits)
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits

    def pairs(members: DataFrame, apart) -> DataFrame:
        l, r = members.alias("l"), members.alias("r")
        on = (F.col("l.sig") == F.col("r.sig")) & (F.col("l.fp") < F.col("r.fp")) & close(F.col("l.fp"), F.col("r.fp")) & apart
        return l.join(r, on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()

    members = stage_table(shared_only(sig), "members")
    edges = pairs(members.where(f"n <= {SMALL}"), F.lit(True))
    crowded = stage_table(members.where(f"n > {SMALL}"), "crowded")
    if not crowded.isEmpty():
        inside = stage_table(crowded.select(F.shiftright("sig", 38).cast("int").alias("table"), "node", "fp").distinct(), "inside")
        near = stage_table(neighbour_links(inside, min(2, max_bits)), "near")
        part = connected_components(near)
        known = crowded.where(f"n <= {LARGE}").join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        edges = edges.unionByName(near).unionByName(pairs(known, F.col("l.part") != F.col("r.part")))
        large = crowded.where(f"n > {LARGE}").select(F.shiftright("sig", 38).cast("int").alias("table"), "node", "fp").distinct()
        if max_bits > 2 and not large.isEmpty():
            edges = edges.unionByName(neighbour_links(large, max_bits))
    return stage_table(edges, "links")


def near_duplicates(docs: DataFrame, keys: list[str], shingle_words: int = 5, max_bits: int = 3, tables: int = 1, text: str = "text", order: str = "doc_id") -> DataFrame:
    """keys, fps and component_id: the smallest `order` reachable over links of at most max_bits differing bits.

    Documents of one fingerprint belong together; a text without words has fingerprint zero and is linked like any
    other. Rows are identified by keys; repeated rows each get a row. Null ids take part and get the component of
    their group, null if the group has no id at all. Extra columns of docs are not read.
    """
    rows = stage_table(fingerprints(docs, keys, shingle_words, tables, text=text), "fingerprints")
    node = F.col("fps")[0] if tables == 1 else F.xxhash64("fps")
    rows = rows.withColumn("node", node)
    each = rows.select("node", "fps").distinct().select("node", F.posexplode("fps").alias("table", "fp")).select("table", "node", "fp").distinct()
    comp = connected_components(fingerprint_links(each, max_bits))
    if tables > 1:  # equal fingerprints in one table link as well
        same = each.groupBy("table", "fp").agg(F.min("node").alias("b"), F.max("node").alias("m")).where("m <> b")
        links = fingerprint_links(each.groupBy("table", "fp").agg(F.min("node").alias("node")), max_bits)
        comp = connected_components(links.unionByName(each.join(same, ["table", "fp"]).where("node <> b").select(F.col("node").alias("a"), "b")))
    comp = stage_table(comp, "components")
    # the smallest id of each fingerprint, then of each component: group sums first, so that hot groups shrink
    low = rows.groupBy("node").agg(F.min(order).alias("low")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    label = low.join(least, "component").select("node", "component_id")
    return rows.join(label, "node").select(*keys, "fps", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, max_bits: int = 3, tables: int = 1, text: str = "text") -> DataFrame:
    """docs without all but one document of each near-duplicate group: the one with the smallest doc_id stays.

    Rows that repeat the kept doc_id and text are one document and stay once. A group without any doc_id keeps the
    text with the smallest hash. All columns of docs stay.
    """
    keys = spare_names(docs, "sim_id", "sim_no", "sim_h")
    h, no = F.xxhash64(F.coalesce(text, F.lit(""))), F.col("doc_id").isNull()
    keyed = docs.withColumns(dict(zip(keys, [F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62)), no, h], strict=True)))
    found = near_duplicates(keyed, keys, shingle_words, max_bits, tables, text, keys[0])
    keep = found.groupBy("component_id").agg(F.min(F.struct(*keys)).alias("x")).select("x.*")
    return keyed.join(keep, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)

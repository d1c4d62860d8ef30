"""Document fingerprints by winnowing: hashes of k consecutive words, the smallest of every window, with positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage_table, spare_names, with_global_rank, words

#: Karp-Rabin arithmetic modulo a 31-bit prime: products of two residues stay within a long.
PRIME = (1 << 31) - 1
BASE = 1_000_003
K = 5
WINDOW = 12
LOW = (1 << 32) - 1


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with the array column `out` of longs: 31 bits of hash, then 32 bits of 0xffffffff minus the word position.

    Every run of window + k - 1 words that two texts share gives them a hash in common, at known positions. Among equal
    hashes of a window the rightmost counts. Spans double: the hash of 2m words comes from two hashes of m words, and
    the minimum of 2m grams from two minima of m, so each step is one pass over an array and stays in the JVM.
    A text of fewer than k words is one gram; one of fewer than `window` grams has their smallest; none: an empty array.
    """
    w, one, h, n = spare_names(df, "fp_words", "fp_one", "fp_array", "fp_size")
    after = lambda c, by: F.slice(c, by + 1, F.greatest(F.col(n), F.lit(1)))
    df = df.withColumn(w, words(F.col(text))).withColumn(n, F.size(w))
    df = df.withColumn(one, F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)).cast("long"))).withColumn(h, F.col(one))
    have = 1
    while have < k:  # roll on: the hash of `have` words, moved up, plus that of the next ones
        step = have if 2 * have <= k else 1
        power = pow(BASE, step, PRIME)
        df = df.withColumn(h, F.zip_with(h, after(h if step == have else one, have), lambda a, b: (a * power + b) % PRIME))
        have += step
    whole = F.array(F.pmod(F.xxhash64(F.array_join(w, " ")), F.lit(PRIME)).cast("long"))
    grams = F.when(F.col(n) >= k, F.slice(h, 1, F.greatest(F.col(n) - (k - 1), F.lit(1)))).when(F.col(n) > 0, whole).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(h, grams)
    df = df.withColumn(h, F.transform(h, lambda x, i: x * (1 << 32) + (LOW - i))).withColumn(n, F.size(h))
    have = 1
    while have < window:  # past the end a window holds fewer grams; those are cut off below
        step = min(have, window - have)
        df = df.withColumn(h, F.zip_with(h, after(h, step), lambda a, b: F.least(a, b)))
        have += step
    df = df.withColumn(out, F.array_distinct(F.slice(h, 1, F.greatest(F.col(n) - (window - 1), F.lit(1)))))
    return df.drop(w, one, h, n)


def hashes(fp) -> F.Column:
    """The set of hashes of a fingerprint, as ints in rising order."""
    return F.array_sort(F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 32).cast("int"))))


def positions(fp) -> F.Column:
    return F.transform(fp, lambda x: LOW - x.bitwiseAND(LOW))


def digest(fp) -> F.Column:
    """A short name for a fingerprint: equal fingerprints have equal digests."""
    return F.md5(F.array_join(F.transform(fp, lambda x: x.cast("string")), ",").cast("binary"))


def likeness(a, b) -> F.Column:
    """Jaccard similarity of two hash sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def fingerprint_documents(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """docs with `fingerprint`, an array of (hash, position) by rising position.

    Null and blank texts have none. Repeated rows and equal texts have equal fingerprints. No shuffle. A column named
    fingerprint is replaced.
    """
    fp = with_fingerprint(docs.drop("fingerprint"), text, "fingerprint", k, window)
    return fp.withColumn("fingerprint", F.transform("fingerprint", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("hash"), (LOW - x.bitwiseAND(LOW)).alias("position"))))


def compare_with_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint against that of an edited text and of the next document.

    The edited text has its last quarter (code points, rounded down) replaced by as many from the start of the next
    document by doc_id, the first after the last. Null texts are empty; null ids come last. Rows that repeat both doc_id
    and text count as one document in the order and each get a row; rows that repeat only doc_id are ordered by a hash
    of the text. Other columns of docs are not read.

    The order is found on ids and lengths alone. Texts are shuffled once; what a document needs of its successor, a
    prefix and hashes, moves to where its text is.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    key = ["id", "no_id", "h"]
    keyed = base.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h"), "text")
    own = with_fingerprint(keyed.withColumn("n_chars", F.length("text").cast("long")), "text", "fp", k, window)
    own = stage_table(own.select(*key, "n_chars", hashes(F.col("fp")).alias("set"), digest(F.col("fp")).alias("fingerprint")), "own")
    order = stage_table(with_global_rank(own.select(*key, "n_chars").distinct(), [F.col(c) for c in ("no_id", "id", "h")], "rank"), "order")
    n = max(order.count(), 1)
    succ = order.select(F.pmod(F.col("rank") - 1, F.lit(n)).alias("rank"), *[F.col(c).alias(f"next_{c}") for c in key])
    links = stage_table(order.join(succ, "rank").drop("rank"), "links")
    # what the plan knows of each document: its hashes and those of its successor
    sets = own.dropDuplicates(key)
    info = links.join(sets.select(*key, "set", "fingerprint"), key)
    info = info.join(sets.select(*[F.col(c).alias(f"next_{c}") for c in key], F.col("set").alias("next_set")), [f"next_{c}" for c in key])
    info = info.select(*key, "n_chars", "set", "fingerprint", likeness(F.col("set"), F.col("next_set")).alias("near_next"))
    # each document sends the prefix that its predecessor needs there; of rows that repeat id and text one speaks
    wanted = links.select(F.floor(F.col("n_chars") / 4).cast("int").alias("need"), *[F.col(c).alias(f"to_{c}") for c in key], *[F.col(f"next_{c}").alias(c) for c in key])
    heads = keyed.join(wanted, key).select(*[F.col(f"to_{c}").alias(c) for c in key], F.substring("text", F.lit(1), F.col("need")).alias("head"))
    heads = heads.groupBy(*key).agg(F.first("head").alias("head"))
    both = keyed.join(info, key).join(heads, key)
    cut = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), cut), "head")).drop("text", "head")
    out = with_fingerprint(edited, "edited", "fp", k, window)
    out = out.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).drop("edited").withColumns({"edited_set": hashes(F.col("fp")), "edited_fingerprint": digest(F.col("fp"))})
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"), "near_next",
    )

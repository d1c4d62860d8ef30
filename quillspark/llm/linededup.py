"""Line dedup: content-defined chunks of lines, found again anywhere in the corpus, compared byte by byte and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import SPACE, drop_staged, spare_names, stage_table

#: A boundary follows a line where the rolling hash of it and the lines before it is 0 modulo DIVISOR.
DIVISOR = 2
ROLL = 2
#: A line of at least this many words always is a chunk of its own, so that a passage of one line is found too.
LONG_LINE = 20
PRIME = (1 << 31) - 1
BASE = 1_000_003


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"line_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "line_h": F.xxhash64(F.coalesce("text", F.lit("")))})


def line_chunks(docs: DataFrame, divisor: int = DIVISOR, roll: int = ROLL, long_line: int = LONG_LINE) -> DataFrame:
    """docs with `lines`, their `line_full` hashes and `line_words`, and `chunks`, an array of (start, n, words) in order, which covers the lines.

    The rolling hash of a line covers it and the roll - 1 lines before it. It alone, and the lengths of the lines on
    both sides, decide on a boundary, so an insertion moves none beyond its neighbourhood.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("lines", F.split(text, "\n", -1))
    d = d.withColumn("line_full", F.transform("lines", lambda x: F.xxhash64(x)))
    d = d.withColumn("line_hash", F.transform("line_full", lambda x: F.pmod(x, F.lit(PRIME)).cast("long")))
    d = d.withColumn("line_words", F.transform("lines", lambda x: F.size(F.split(x, SPACE))))
    roll_at = lambda i: sum(((F.when(i - j >= 0, F.get("line_hash", i - j)).otherwise(F.lit(0).cast("long")) * pow(BASE, j, PRIME)) % PRIME for j in range(1, roll)), F.get("line_hash", i))
    # line i starts a chunk if the one before ends one, or either is long
    starts = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: (i == 0) | (F.get("line_words", i) >= long_line) | (F.get("line_words", i - 1) >= long_line) | (F.xxhash64(roll_at(i - 1)) % divisor == 0),
    )
    d = d.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("lines")))
    d = d.withColumn("chunks", F.zip_with("starts", ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("n"), F.get("line_words", a).alias("words"))))
    return d.drop("starts")


def _marks(narrow: DataFrame, extra: str) -> DataFrame:
    """(line_id, line_h, marks): what occurs more than once, gathered for each document; the first by (doc_id, position) is_kept."""
    groups = narrow.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("line_id", "line_h", "start")).alias("kept")).where("times > 1")
    found = narrow.join(groups.select("chunk_hash", "kept"), "chunk_hash")
    is_kept = (F.col("kept.line_id") == F.col("line_id")) & (F.col("kept.line_h") == F.col("line_h")) & (F.col("kept.start") == F.col("start"))
    return found.groupBy("line_id", "line_h").agg(F.collect_set(F.struct(extra, "start", "n", "chunk_hash", is_kept.alias("is_kept"))).alias("marks"))  # of one document


def _agreed(parts: DataFrame) -> DataFrame:
    """(line_id, line_h, drops): parts equal to the kept one byte by byte, with the lines on both sides as far as they agree."""
    kept = parts.where("is_kept").dropDuplicates(["chunk_hash"]).select("chunk_hash", *[F.col(c).alias(f"kept_{c}") for c in ("body", "before", "after")])
    same = parts.where("not is_kept").join(kept, "chunk_hash").where("body = kept_body")
    agree = lambda a, b: F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1, F.lit(-1))
    run = lambda a, b: F.when(agree(a, b) >= 0, agree(a, b)).otherwise(F.least(F.size(a), F.size(b)))
    same = same.withColumns({"up": run("before", "kept_before").cast("int"), "down": run("after", "kept_after").cast("int")})
    return same.groupBy("line_id", "line_h").agg(F.collect_set(F.struct((F.col("start") - F.col("up")).alias("start"), (F.col("n") + F.col("up") + F.col("down")).alias("n"))).alias("drops"))


def repeated_lines(docs: DataFrame, divisor: int = DIVISOR, roll: int = ROLL, long_line: int = LONG_LINE) -> DataFrame:
    """(line_id, line_h, drops): the spans (start, n) of lines to remove from each document.

    A chunk counts if it has more than one line or is one long line. Of chunks that occur more than once, the first by
    (doc_id, position) stays; null ids come last. Each other occurrence is compared with it byte by byte, and so are the
    lines of the neighbouring chunks, outwards while they agree: that finds the ends of a repeated passage which share
    a chunk with foreign lines. A removed line always has an equal one at an earlier place, so one copy of it stays.
    """
    chunked = line_chunks(_key(docs), divisor, roll, long_line).select("line_id", "line_h", "lines", "chunks")
    body = lambda c: F.array_join(F.slice("lines", c["start"] + 1, c["n"]), "\n")
    marked = F.transform("chunks", lambda c, k: F.struct(k.alias("k"), c["start"].alias("start"), c["n"].alias("n"), F.when((c["n"] > 1) | (c["words"] >= long_line), F.xxhash64(body(c))).alias("chunk_hash")))
    narrow = stage_table(chunked.select("line_id", "line_h", F.inline(marked)).where("chunk_hash is not null"), "chunks")
    marks = _marks(narrow, "k")
    # one shuffle of the texts, from which only the marked chunks and their neighbours go on
    side = lambda k: F.coalesce(F.slice("lines", F.get("chunks", k)["start"] + 1, F.get("chunks", k)["n"]), F.array().cast("array<string>"))
    cut = F.transform("marks", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["chunk_hash"].alias("chunk_hash"), s["is_kept"].alias("is_kept"), body(s).alias("body"), F.reverse(side(s["k"] - 1)).alias("before"), side(s["k"] + 1).alias("after")))
    parts = chunked.join(marks.hint("merge"), ["line_id", "line_h"])  # the same join at every size
    parts = parts.select("line_id", "line_h", F.inline(cut))
    parts = stage_table(parts, "parts")
    return _agreed(parts)


def line_seeds(docs: DataFrame, divisor: int = DIVISOR, roll: int = ROLL, long_line: int = LONG_LINE) -> DataFrame:
    """docs with `lines`, `line_full` and `seeds`, an array of (start, n, is_short).

    From every line, downwards and upwards, the fewest lines that have long_line words together are a seed; a long line
    alone is one. Whatever run of lines two documents share, if it has long_line words then each of its lines is in a
    seed within it. Chunks of several lines with fewer words are short seeds.
    """
    d = line_chunks(docs, divisor, roll, long_line)
    # a line counts as a word at least, so long_line lines always suffice
    add = lambda s, w: F.when(s["words"] >= long_line, s).otherwise(F.struct((s["words"] + w).alias("words"), (s["n"] + 1).alias("n")))
    reach = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), add, lambda s: F.when(s["words"] >= long_line, s["n"]).otherwise(0))
    below = lambda i: F.slice("line_words", i + 1, F.lit(long_line))
    above = lambda i: F.reverse(F.slice("line_words", F.greatest(i - long_line + 1, F.lit(0)) + 1, F.least(i + 1, F.lit(long_line))))
    size = long_line + 1  # start and n in one long, whose repeats go by hash
    code = lambda start, n: start.cast("long") * size + n
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    short = F.filter(at, lambda i: F.get("line_words", i) < long_line)
    down = F.transform(at, lambda i: F.when(F.get("line_words", i) >= long_line, code(i, 1)).otherwise(code(i, reach(below(i)))))
    up = F.transform(F.transform(short, lambda i: F.struct(i.alias("i"), reach(above(i)).alias("n"))), lambda s: F.when(s["n"] > 0, code(s["i"] - s["n"] + 1, s["n"])).otherwise(F.lit(0).cast("long")))
    spans = F.array_distinct(F.filter(F.concat(down, up), lambda c: c % size > 0))
    seeds = F.transform(spans, lambda c: F.struct(F.floor(c / size).cast("int").alias("start"), (c % size).cast("int").alias("n"), F.lit(False).alias("is_short")))
    total = lambda c: F.aggregate(F.slice("line_words", c["start"] + 1, c["n"]), F.lit(0), lambda s, w: s + w)
    few = F.filter("chunks", lambda c: F.when((c["n"] > 1) & (c["n"] < long_line), total(c) < long_line).otherwise(False))
    few = F.transform(few, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.lit(True).alias("is_short")))
    return d.withColumn("seeds", F.concat(seeds, few)).drop("chunks", "line_words")


def repeated_passages(docs: DataFrame, divisor: int = DIVISOR, roll: int = ROLL, long_line: int = LONG_LINE, tables: list[DataFrame] | None = None) -> DataFrame:
    """(line_id, line_h, drops) as repeated_lines has it, for every run of lines that occurs earlier too.

    Each run of long_line words or more goes from end to end: its lines all are in seeds that repeat. Shorter runs are
    found if they hold a short seed, and go to their ends as well. All seeds are compared byte by byte. tables gets the
    staged tables that the result reads.
    """
    keyed = _key(docs)
    hashed = lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["is_short"].alias("is_short"), F.xxhash64(F.slice("line_full", s["start"] + 1, s["n"])).alias("chunk_hash"))
    seeds = line_seeds(keyed, divisor, roll, long_line).select("line_id", "line_h", F.inline(F.transform("seeds", hashed)))
    seeds = stage_table(seeds, "seeds")
    marks = _marks(seeds, "is_short")
    texts = keyed.select("line_id", "line_h", F.coalesce("text", F.lit("")).alias("text")).join(marks.hint("merge"), ["line_id", "line_h"])  # the same join at every size
    texts = texts.select("line_id", "line_h", F.split("text", "\n", -1).alias("lines"), "marks")
    # a run that goes on over a long line, or over long_line lines, is covered by seeds
    near = lambda a: F.transform(a, lambda x: F.when(F.size(F.split(x, SPACE)) < long_line, x))
    none = F.array().cast("array<string>")
    room = F.lit(long_line - 1)
    before = lambda s: F.when(s["is_short"], F.reverse(near(F.slice("lines", F.greatest(s["start"] - room, F.lit(0)) + 1, F.least(s["start"], room))))).otherwise(none)
    after = lambda s: F.when(s["is_short"], near(F.slice("lines", s["start"] + s["n"] + 1, room))).otherwise(none)
    cut = F.transform("marks", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["chunk_hash"].alias("chunk_hash"), s["is_kept"].alias("is_kept"), F.array_join(F.slice("lines", s["start"] + 1, s["n"]), "\n").alias("body"), before(s).alias("before"), after(s).alias("after")))
    parts = stage_table(texts.select("line_id", "line_h", F.inline(cut)), "parts")
    drop_staged(seeds)
    if tables is not None:
        tables.append(parts)
    return _agreed(parts)


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, roll: int = ROLL, long_line: int = LONG_LINE, whole: bool = False) -> DataFrame:
    """docs with the repeated lines cut from text, and n_removed, how many lines went.

    whole: repeated runs of long_line words or more go from end to end (repeated_passages); else only what the chunks
    and their neighbours reach (repeated_lines).
    Null texts stay null; a document all of whose lines are repeats stays with an empty text. Rows that repeat both
    doc_id and text are one document, of which each row keeps the same lines. Documents without repeats keep their text
    byte for byte. An empty table stays empty. Columns named n_removed, line_id or line_h are replaced; others stay.
    """
    docs = docs.drop("n_removed", "line_id", "line_h")
    drops, every, left, text = spare_names(docs, "line_drops", "line_all", "line_left", "line_text")
    tables: list[DataFrame] = []
    runs = repeated_passages(docs, divisor, roll, long_line, tables) if whole else repeated_lines(docs, divisor, roll, long_line)
    found = stage_table(runs, "drops").withColumnRenamed("drops", drops)
    for table in tables:
        drop_staged(table)
    out = _key(docs).join(found.hint("merge"), ["line_id", "line_h"], "left")
    cut = F.col(drops).isNotNull()
    out = out.withColumn(every, F.when(cut, F.split("text", "\n", -1)))
    spans = F.flatten(F.transform(drops, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    out = out.withColumn(left, F.when(cut, F.array_except(F.sequence(F.lit(0), F.size(every) - 1), spans)))
    out = out.withColumn(text, F.when(cut, F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n")).otherwise(F.col("text")))
    n = F.when(cut, F.size(every) - F.size(left)).otherwise(0).cast("long")
    return out.withColumn("n_removed", n).select(*[F.col(text).alias("text") if c == "text" else F.col(c) for c in docs.columns], "n_removed")

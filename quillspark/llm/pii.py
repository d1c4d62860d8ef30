"""Personal data: exact base patterns, plus overlapping candidates of looser formats that boosted trees score and thresholds select."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from .common import spare_names, stage_table

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. (?<!x)|\G makes a match begin where a run begins or where the last match ended: the same leftmost
#: matches, but no second look at the inside of long runs. Possessive quantifiers where nothing follows that could want
#: characters back: no recursion on very long chains.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: high recall, and they overlap.
LOOSE = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[\w-]{1,63}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[\w-]{1,63}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:(?:[.,]|\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,4}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)\x20?)?\(?[0-9]{1,4}+\)?(?:[\x20./-]{0,2}\(?[0-9]{2,4}+\)?){2,5}(?![0-9])",
}
CUES = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|addr|login|from",
    "card": r"(?i)card|karte|carte|tarjeta|visa|credit|pay|iban",
    "phone": r"(?i)tel|phone|call|fax|mobil|ruf|llam",
}
#: The precision that a threshold must reach.
PRECISION = 0.98
#: What an unlabelled candidate weighs as a wrong one, beside a base match, when the first trees are fitted.
DOUBT = 0.25
#: Spans that touch meet in a block of so many characters.
BLOCK = 64
#: Characters of context before a match.
CONTEXT = 24


def _guard(kind: str, text) -> F.Column:
    return {"email": F.contains(text, F.lit("@")) | F.contains(text, F.lit("at")), "phone": F.contains(text, F.lit("+")) | text.rlike("[0-9]")}.get(kind, text.rlike("[0-9]"))


def with_matches(df: DataFrame, text: str, out: str, regex: str, guard, kind: int, loose: bool) -> DataFrame:
    """df with the array column out: a struct for each match of regex, with its value, its number, how many code points
    lie between it and the match before, and the text around it. Linear in the text: nothing looks back to its start.
    """
    m, p = spare_names(df, "pii_m", "pii_p")
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(guard, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(none))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(text, regex, -1)).otherwise(none))
    before = lambda i: F.substring(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(p, i)), -CONTEXT, CONTEXT)
    found = lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), i.alias("at"), F.length(F.get(p, i)).alias("gap"), before(i).alias("before"), x.alias("value"), F.substring(F.get(p, i + 1), 1, 1).alias("after"))
    return df.withColumn(out, F.transform(m, found)).drop(m, p)


def luhn(digits) -> F.Column:
    """Does a string of digits pass the Luhn check?"""
    d = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    s = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(d(i))).otherwise(d(i)))
    return s % 10 == 0


def valid(kind: str, value) -> F.Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def rewritten(kind: str, value, style) -> F.Column:
    """A base match as others might write it: in one of three loose formats, which the base pattern does not match."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    by = lambda *forms: F.when(style == 0, forms[0]).when(style == 1, forms[1]).otherwise(forms[2])
    if kind == "email":
        name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        return by(F.concat(name, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))), F.concat(name, F.lit("[at]"), host), F.concat(name, F.lit(" @ "), host))
    if kind == "ip":
        return by(*[F.replace(value, F.lit("."), F.lit(x)) for x in (",", "[.]", " . ")])
    if kind == "card":
        return by(*[F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1" + x) for x in (".", "/", "- ")])
    bare = F.regexp_replace(value, r"^\+", "")
    return by(F.concat(F.lit("00"), bare), F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]?(?=[\x20(]*[0-9])", ""), F.regexp_replace(F.trim(F.regexp_replace(bare, "[^0-9]+", " ")), " ", "."))


def spoiled(kind: str, value) -> F.Column:
    """Something of a base match's looks that is none: null where there is no such thing."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.concat(F.regexp_extract(value, r"^(.*\.)[0-9]+$", 1), (F.regexp_extract(value, "([0-9]{1,3})$", 1).cast("int") + 300).cast("string"))
    if kind == "card":
        return F.concat(F.regexp_replace(digits, "[0-9]$", ""), F.pmod(F.substring(digits, -1, 1).cast("int") + 1, F.lit(10)).cast("string"))
    if kind == "phone":
        return F.concat_ws("-", F.substring(digits, -6, 2), F.substring(digits, -4, 2), F.substring(digits, -2, 2))
    return F.lit(None).cast("string")


def _features() -> F.Column:
    """Numbers about the columns kind, value, before and after: format and context, and nothing of the base patterns."""
    v = F.col("value")
    n = lambda r: F.regexp_count(v, F.lit(r))
    digits = F.regexp_replace(v, "[^0-9]", "")
    numbers = F.transform(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), lambda x: F.substring(x, 1, 9).cast("int"))
    cue = F.lit(False)
    for k, kind in enumerate(KINDS):
        cue = F.when(F.col("kind") == k, F.col("before").rlike(CUES[kind])).otherwise(cue)
    flags = [F.col("kind") == k for k in range(len(KINDS))]
    form = [F.length(v), F.length(digits), F.size(numbers), F.coalesce(F.array_max(numbers), F.lit(0)), n(r"\."), n("-"), n("/"), n(r"\x20"), n(r"[()]"), n(r"[\[\]]"), n("@"), n("[A-Za-z]"), F.when(F.length(digits).between(1, 32), luhn(digits)).otherwise(F.lit(False)), F.startswith(v, F.lit("+")), F.startswith(v, F.lit("0"))]
    around = [cue, F.col("before").rlike(r"[\w]$"), F.col("after").rlike(r"^[\w]"), F.col("after") == ""]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in [*flags, *form, *around]])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with hits: the matches of all base patterns and generators; see with_matches."""
    df, found = docs, []
    for k, kind in enumerate(KINDS):
        for loose, patterns in ((False, BASE), (True, LOOSE)):
            found.append(f"pii_{kind}_{int(loose)}")
            df = with_matches(df, text, found[-1], patterns[kind], _guard(kind, F.col(text)), k, loose)
    return df.withColumn("hits", F.concat(*found)).select(*docs.columns, "hits")


def _of_kind(f, *args) -> F.Column:
    """f(kind's name, ...) of the row's kind."""
    out = F.lit(None)
    for k, kind in enumerate(KINDS):
        out = F.when(F.col("kind") == k, f(kind, *args)).otherwise(out)
    return out


def _blocks(spans: DataFrame) -> DataFrame:
    """Each span once for every block of the text that it lies in."""
    return spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))))


def _untouched(spans: DataFrame, others: DataFrame, worse=None) -> DataFrame:
    """The spans that overlap none of the others of their text (worse(l, r): that matter). A block holds few of either."""
    l, r = _blocks(spans).alias("l"), _blocks(others).alias("r")
    on = (F.col("l.row") == F.col("r.row")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end"))
    hit = l.join(r, on if worse is None else on & worse, "left_semi").select("row", "kind", "start").distinct()
    return spans.join(hit, ["row", "kind", "start"], "left_anti")


def _chosen(candidates: DataFrame, base: DataFrame, precision: float, seed: int) -> DataFrame:
    """The candidates whose calibrated score selects them: trees fitted on all examples, thresholds on what trees of one half say of the other.

    Right are base matches rewritten into loose formats, in the context they came from; wrong are base matches spoiled,
    and candidates outside all base matches. Neither label can be read off a feature: no candidate is a base match.
    Nobody has labelled the candidates, so first trees drop those that look right from the wrong ones; second trees and
    the thresholds go by what is left.
    """
    order = F.xxhash64(F.lit(seed), "row", "kind", "start", "source")
    style = F.pmod(F.xxhash64("row", "start", "kind"), F.lit(3))
    about = ["row", "kind", "start", "before", "after"]
    right = base.select(*about, _of_kind(rewritten, F.col("value"), style).alias("value"), F.lit(0).alias("source"))
    spoilt = base.select(*about, _of_kind(spoiled, F.col("value")).alias("value"), F.lit(1).alias("source")).where("value is not null")
    spoilt = spoilt.withColumn("value", F.when(F.col("kind") == KINDS.index("phone"), F.col("value")).otherwise(_of_kind(rewritten, F.col("value"), style)))
    open_ = candidates.select(*about, "value", F.lit(2).alias("source"))
    made = right.unionByName(spoilt).unionByName(open_)
    made = stage_table(made.select("kind", "source", (F.col("source") == 0).cast("double").alias("label"), (F.pmod(order, F.lit(2)) == 0).alias("half"), _features().alias("features")), "examples")
    part = made.groupBy("half").agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).collect()
    if len(part) < 2 or any(min(r[1], r[2]) < 10 for r in part):  # nothing to learn from
        return candidates.where(F.lit(False)).withColumn("p", F.lit(0.0))
    vector = lambda d: d.withColumn("v", array_to_vector("features"))
    trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.3, seed=seed)
    scored = lambda model, d: model.transform(vector(d)).withColumn("p", F.round(vector_to_array("probability")[1], 2)).drop("v", "rawPrediction", "probability", "prediction")
    doubt = F.when(F.col("source") == 2, F.lit(DOUBT)).otherwise(1.0)
    first = trees.copy().setWeightCol("w").fit(vector(made.withColumn("w", doubt)))
    clear = stage_table(scored(first, made).where("source < 2 or p <= 0.5").drop("p"), "clear")
    model = trees.fit(vector(clear))
    unseen = [scored(trees.fit(vector(clear.where(other))), clear.where(half)) for half, other in (("half", "not half"), ("not half", "half"))]
    held = unseen[0].unionByName(unseen[1]).groupBy("kind", "p").agg(F.count_if(F.col("label") == 1).alias("good"), F.count(F.lit(1)).alias("n")).collect()  # 101 scores for each kind at most
    limit = F.lit(None).cast("double")
    for k in range(len(KINDS)):
        good = n = 0
        best = None
        for r in sorted((r for r in held if r["kind"] == k), key=lambda r: -r["p"]):
            good, n = good + r["good"], n + r["n"]
            if good >= precision * n and r["p"] > 0.5:
                best = r["p"]
        if best is not None:
            limit = F.when(F.col("kind") == k, F.lit(best)).otherwise(limit)
    return scored(model, candidates.withColumn("features", _features())).where(F.col("p") >= limit)


def find_personal_data(docs: DataFrame, keys: list[str], text: str = "text", precision: float = PRECISION, seed: int = 42) -> DataFrame:
    """keys, base and spans: arrays of (kind index, start, end), by kind as in KINDS, then start.

    base has the leftmost non-overlapping matches of each kind's pattern that pass its check. spans adds candidates
    which touch no base span, score at least their kind's threshold, and touch no better one. Trees are fitted on
    all examples of either label; trees of one half set the thresholds by the other half, both ways. Tables with too few examples of
    either label add none. Null texts are empty; repeated rows each get a row; other columns stay out.
    """
    rows = docs.select(*keys, F.coalesce(text, F.lit("")).alias("pii_text"))
    rows = stage_table(scan(rows, "pii_text").drop("pii_text").withColumn("row", F.monotonically_increasing_id()), "matches")
    hits = rows.where(F.size("hits") > 0).select("row", F.inline("hits"))
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "kind", "loose").orderBy("at"))  # within one text
    hits = hits.withColumn("end", upto.cast("int")).withColumn("start", F.col("end") - F.length("value"))
    hits = stage_table(hits.where(F.col("loose") | _of_kind(valid, F.col("value"))).drop("at", "gap"), "hits")
    base = hits.where("not loose")
    cand = stage_table(_untouched(hits.where("loose"), base.select("row", "start", "end")), "candidates")
    picked = _chosen(cand, base, precision, seed).select("row", "kind", "start", "end", "p")
    picked = stage_table(picked, "picked")
    rank = lambda a: F.struct(F.col(f"{a}.p"), F.col(f"{a}.end") - F.col(f"{a}.start"), F.col(f"{a}.kind"), F.col(f"{a}.start"))
    extra = _untouched(picked, picked, rank("r") > rank("l"))
    span = F.struct("kind", "start", "end")
    both = base.select("row", span.alias("s"), F.lit(True).alias("is_base")).unionByName(extra.select("row", span.alias("s"), F.lit(False).alias("is_base")))
    lists = both.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("is_base"), F.col("s")))).alias("base"), F.sort_array(F.collect_list("s")).alias("spans"))  # of one text
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.drop("hits").join(lists, "row", "left").select(*keys, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def spans_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_documents(docs: DataFrame, **kw) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; other columns stay, null texts stay null.

    Of spans that overlap, the later ones lose what is gone. Texts are cut at the spans once, from front to end.
    """
    key, cut, chars, names = spare_names(docs, "pii_key", "pii_cut", "pii_chars", "pii_names")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")))
    found = find_personal_data(keyed.select(key, "text"), [key], **kw).dropDuplicates([key])
    s = found.select(F.col(key), F.inline("spans"))
    gone = F.max("end").over(Window.partitionBy(key).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))  # within one text
    s = s.withColumn("start", F.greatest("start", F.coalesce(gone, F.lit(0)))).where("end > start")
    cuts = s.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(cut))
    out = keyed.withColumnRenamed(key, "l_" + key).join(cuts, F.col("l_" + key).eqNullSafe(F.col(key)), "left")
    out = out.withColumns({chars: F.when(F.col(cut).isNotNull(), F.split("text", "")), names: F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])})
    begin = lambda i: F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))
    parts = F.transform(cut, lambda x, i: F.concat(F.array_join(F.slice(chars, begin(i) + 1, x["start"] - begin(i)), ""), F.get(names, x["kind"])))
    last = F.element_at(cut, -1)["end"]
    rest = F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), "")
    return out.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest))).select(*docs.columns)

"""Column functions over text: Column in, Column out, all of them built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Unicode ranges that count as CJK for keyword tokens.
CJK = "⺀-⿟　-〿㇀-㇯㐀-䶿一-鿿豈-﫿︰-﹏"
HAN = "一-鿿"
#: Words that make a question one for a list.
ENUMERATION_HINTS = ["哪些", "全部", "所有", "列举", "枚举", "对比", "区别", "差异", "清单", "有几"]
#: Words for the newest state of something, and weak time signals.
LATEST = ["最新版本", "最新的", "当前版本", "当前的", "目前的", "现在的", "latest", "current", "newest", "up-to-date"]
TIME_ADVERBS = ["最近", "近期", "近日", "刚刚", "即将", "不久前", "recently", "lately"]
#: Fixed patterns of claims that age.
VERSION = r"(?i)(?:(?:v|版本|version)\s*[\d.]+[a-zA-Z0-9.-]*|(?:Java|Python|Node|Go|Ruby|PHP|\.NET|Spring|Django|React|Vue)\s+\d+(?:\.\d+)*|\b\d+\.\d+(?:\.\d+)?(?:\.\d+)?[a-zA-Z0-9-]*\b)"
#: The same matches as VERSION: positions at which none of its forms can begin go by one look.
VERSION_FAST = r"(?i)(?=[vjpngrds.版\d])" + VERSION
DATE = r"(?:20[12]\d年|20[12]\d[-/]\d{1,2}|(?:于|在|截至|从|到|自)\s*20[12]\d)"
DATA = r"(?:\$[\d.]+[KMBT]|\d+(?:\.\d+)?[万亿千百]+|排名第\d+)"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _bigrams(runs: Column) -> Column:
    pairs = lambda s: F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, pairs))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tokenize(c: Column) -> Column:
    """SC1: a bag of keyword tokens. Paths and their parts, versions, numbers, CJK runs and bigrams, words of 3 letters.

    Patterns whose signs a text lacks are not searched for in it: one cheap look tells.
    """
    none = F.array().cast("array<string>")

    def tokens(t: Column) -> Column:
        paths = once(_all(t, "/[a-zA-Z0-9/_]+"), lambda p: F.concat(p, F.flatten(F.transform(p, lambda x: _all(x, "[a-zA-Z0-9]+")))))
        numbers = once(_all(t, r"\d+"), lambda n: F.when(F.size(n) > 0, F.concat(_all(t, r"(?<![a-z0-9])v\d+(?![a-z0-9])"), n)).otherwise(none))
        runs = once(_all(t, f"[{CJK}]+"), lambda r: F.concat(F.filter(r, lambda s: F.length(s) >= 2), _bigrams(r)))
        far = (F.octet_length(t) > F.length(t) + 1) & t.rlike(f"[{CJK[0]}-{CJK[-1]}]")  # a CJK sign has three bytes
        return F.concat(F.when(F.contains(t, F.lit("/")), paths).otherwise(none), numbers, F.when(far, runs).otherwise(none), _all(t, r"(?U)\b[a-z]{3,}\b"))

    return once(F.lower(F.coalesce(c, F.lit(""))), tokens)


def name_tokens(c: Column) -> Column:
    """SC2: the set of tokens by which a document's name is recognised in a question."""
    t = F.lower(F.coalesce(c, F.lit("")))
    v = _all(t, r"(?<![a-z0-9])v?\d+(?:\.\d+)*(?![a-z0-9])")
    majors = F.transform(F.filter(v, lambda x: F.contains(x, F.lit("."))), lambda x: F.split(x, r"\.")[0])
    return F.array_distinct(F.concat(v, F.transform(v, lambda x: F.regexp_replace(x, "^v+", "")), majors, _bigrams(_all(t, f"[{HAN}]{{2,}}")), _all(t, "(?<![a-z])[a-z0-9]{3,}(?![a-z])")))


def has_exact_id(c: Column) -> Column:
    """SC3: does a question name something that only an exact match finds? Null and empty: no."""
    return F.coalesce(c.rlike(r"\d{4,}") | F.contains(c, F.lit("/")) | c.rlike(r"(?i)(?:code|错误码|error)\s*[=:：]?\s*\d"), F.lit(False))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def collapse_blank_lines(c: Column, min_len: int = 100) -> Column:
    """SC5: runs of blank lines become one in texts of at least min_len characters."""
    return F.when(F.length(c) >= min_len, strip(F.regexp_replace(c, r"\n\s*\n\s*\n+", "\n\n"))).otherwise(c)


def title_from_text(c: Column, fallback: Column, max_len: int = 30) -> Column:
    """SC6: the first line with something on it but marks of a heading, cut, with .md; else the fallback."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
    first = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    cut = F.when(F.length(first) > max_len, F.concat(F.substring(first, 1, max_len), F.lit("..."))).otherwise(first)
    return F.concat(F.coalesce(cut, fallback), F.lit(".md"))


def length_gate(c: Column, lo: int = 20, hi: int = 100_000) -> Column:
    return F.coalesce(F.length(c).between(lo, hi), F.lit(False))


def needs_summary(chars: Column, limit: int = 50_000) -> Column:
    return F.coalesce(chars > limit, F.lit(False))


def detect_heading_level(c: Column) -> Column:
    """SC8: 3, or the level 2 to 5 that has at least 3 headings and half as many as the best so far."""
    n = {lv: F.regexp_count(c, F.lit(rf"(?m)^[^\S\n]*#{{{lv}}} ")) for lv in range(2, 6)}
    best, count = F.lit(3), n[3]
    for lv in range(2, 6):
        better = (n[lv] >= 3) & (n[lv] >= count * 0.5)
        best, count = F.when(better, lv).otherwise(best), F.when(better, n[lv]).otherwise(count)
    return F.when(c.isNull(), 3).otherwise(best)


def make_summary(text: Column, title: Column) -> Column:
    """SC9: title, first five API paths and the first telling line, joined by dashes."""
    paths = F.slice(F.array_distinct(_all(text, r"(?:POST|GET|DELETE|PUT):?\s*(/?\S+)", 1)), 1, 5)
    lines = F.transform(F.split(text, "\n"), strip)
    telling = F.filter(lines, lambda x: (F.length(x) >= 10) & ~x.rlike(r"^(?:#|```|\|)") & x.rlike(f"[{HAN}]"))
    return F.concat_ws(" — ", F.nullif(title, F.lit("")), F.when(F.size(paths) > 0, F.array_join(paths, ", ")), F.substring(F.get(telling, F.lit(0)), 1, 80))


def snippet(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def relevance_pct(d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round((1 - d / 2) * 100).cast("int")))


def coverage_class(d: Column, threshold: float = 0.4) -> Column:
    """SC12: none without a context, low beyond the threshold, else covered."""
    return F.when(d.isNull() | (d >= 999.0), "none").when(d > threshold, "low").otherwise("covered")


def is_enumeration(c: Column, hints: list[str] = ENUMERATION_HINTS) -> Column:
    return F.coalesce(c.rlike("|".join(hints)), F.lit(False))


def sanitize_thread(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), 1, 100)


def message_text(kind: Column, content: Column) -> Column:
    """SC15: the text of a chat message without mentions; empty for other kinds and for bad JSON."""
    t = F.get_json_object(content, "$.text")
    return F.when(kind == "text", F.coalesce(strip(F.regexp_replace(t, r"@_user_\d+", "")), F.lit(""))).otherwise("")


def scrub_warning(c: Column, warning: str) -> Column:
    """SC16: without a warning text; three line ends become two, once, from left to right."""
    return F.when(F.contains(c, F.lit(warning)), strip(F.replace(F.replace(c, F.lit(warning), F.lit("")), F.lit("\n\n\n"), F.lit("\n\n")))).otherwise(c)


def time_sensitive_claims(c: Column, current_year: int, strict: bool = False) -> Column:
    """SC17: struct of has_risk, signals, examples and confidence for claims that age; the year is an argument."""
    none = F.array().cast("array<string>")
    years = "|".join(str(y) for y in range(current_year - 5, current_year + 2))
    dates = F.filter(F.when(F.contains(c, F.lit("20")), _all(c, DATE)).otherwise(none), lambda d: d.rlike(years))
    found = F.struct(c.alias("text"), _all(c, VERSION_FAST).alias("versions"), dates.alias("dates"))
    # what a lambda takes is worked out once, however often it is named
    known = F.transform(F.array(found), lambda x: F.struct(x["text"].alias("text"), x["versions"].alias("versions"), x["dates"].alias("dates"), _latest(x["text"], F.lit(strict) | (F.size(x["versions"]) > 0)).alias("words")))
    return F.get(F.transform(known, lambda x: _claims(x["text"], x["versions"], x["dates"], x["words"], strict)), F.lit(0))


def _latest(c: Column, counts: Column) -> Column:
    """The words for the newest state in a text, if they count."""
    lower = F.array(F.when(counts, F.lower(c)))
    return F.get(F.transform(lower, lambda t: F.filter(F.array(*[F.lit(k) for k in LATEST]), lambda k: F.contains(t, k))), F.lit(0))


def _claims(c: Column, versions: Column, dates: Column, words: Column, strict: bool) -> Column:
    """The struct of time_sensitive_claims, from a text's versions, recent dates and words for the newest state."""
    version, date = F.size(versions) > 0, F.size(dates) > 0
    latest = (F.size(words) > 0) & (version | F.lit(strict))
    adverb = F.lit(strict) & F.lower(c).rlike("|".join(TIME_ADVERBS))
    data = _all(c, DATA)
    figure = F.lit(strict) & (F.size(data) > 0)
    names = ["version", "recent_date", "latest_keyword", "time_adverb", "specific_data"]
    flags = [version, date, latest, adverb, figure]
    signals = F.array_compact(F.array(*[F.when(f, n) for f, n in zip(flags, names, strict=True)]))
    none = F.array().cast("array<string>")
    examples = F.slice(F.concat(F.slice(versions, 1, 2), F.slice(dates, 1, 2), F.when(latest, F.array(F.concat(F.lit("关键词: "), F.get(words, F.lit(0))))).otherwise(none), F.when(figure, F.array(F.concat(F.lit("数据: "), F.get(data, F.lit(0))))).otherwise(none)), 1, 3)
    n = F.size(signals)
    level = F.when(version | date, "high").when(latest & (n >= 2), "medium").when(F.lit(strict) & (n >= 2), "low")
    return F.struct(level.isNotNull().alias("has_risk"), signals.alias("signals"), examples.alias("examples"), F.coalesce(level, F.lit("low")).alias("confidence"))


def has_doc_cite(c: Column) -> Column:
    return F.coalesce(c.rlike(r"doc_id[=:]\s*\d+"), F.lit(False))


def has_url_cite(c: Column) -> Column:
    return F.coalesce(c.rlike("https?://") | F.contains(c, F.lit("联网搜索")), F.lit(False))


def extract_citations(c: Column) -> Column:
    """SC19: array of (name, doc_id) of all 《name》[doc_id:n] marks."""
    mark = r"《([^》]+)》\s*\[doc_id[:：]\s*(\d+)\]"
    return F.zip_with(_all(c, mark, 1), _all(c, mark, 2), lambda a, b: F.struct(a.alias("name"), b.cast("bigint").alias("doc_id")))


def estimate_tokens(chars: Column, rate: float = 0.6) -> Column:
    return F.floor(chars * rate)


def normalize_url(c: Column) -> Column:
    """SC21: https:// where no scheme is given, no fragment, no slashes at the end."""
    u = F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.regexp_replace(F.regexp_replace(u, r"(?s)#.*$", ""), "/+$", "")


def parse_doc_url(c: Column) -> Column:
    """SC22: (type, token) of a document link or bare token."""
    path = F.regexp_extract(c, r"^https?://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.get(parts, F.size(parts) - 1)
    named = F.regexp_extract(path, "/(wiki|docx|docs|doc)/([^/]+)", 2)
    kind = F.when(path.rlike("/wiki/[^/]+"), "wiki").when(path.rlike("/(?:docx|docs|doc)/[^/]+"), "docx").otherwise("wiki")
    web = c.rlike("^https?://")
    token = F.when(web, F.coalesce(F.nullif(named, F.lit("")), last)).otherwise(F.regexp_replace(strip(c), r"[?#].*$", ""))
    return F.struct(F.when(web, kind).otherwise("wiki").alias("type"), F.coalesce(token, F.lit("")).alias("token"))


def edge_endpoints(m: Column) -> Column:
    """SC23: (src, dst) of an edge given as a map under any of the usual keys; empty strings are missing."""
    first = lambda keys: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys])
    return F.struct(first(["from", "source", "caller", "src"]).alias("src"), first(["to", "target", "callee", "dst"]).alias("dst"))


def unescape(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_title(html: Column, url: Column) -> Column:
    t = strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(t, F.lit("")), url)


def extract_links(html: Column) -> Column:
    """TX3: all non-empty href of links, in order."""
    return F.filter(_all(html, r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)", 1), lambda x: x != "")


def clean_pdf_text(c: Column) -> Column:
    """TX4: characters that PDF extraction leaves behind become spaces or go."""
    c = F.regexp_replace(c, r"[\p{Co}\p{Cn}\p{Cs}]", " ")
    c = F.regexp_replace(c, "[ ­\t]", " ")
    c = F.regexp_replace(c, "[​-‏⁠﻿]", "")
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\r]]", "")


def postprocess_lines(c: Column) -> Column:
    """TX2: without table-of-contents marks and search headings; lines stripped, blank runs collapsed."""
    lines = F.transform(F.split(c, "\n"), strip)
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?i)^\[TOC\]$") & ~x.rlike(r"(?i)^#{1,6} .*(?:results matching|no results)"))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def page_slice(c: Column, page: Column, size: int = 8000) -> Column:
    return F.nullif(F.substring(c, page * size + 1, F.lit(size)), F.lit(""))

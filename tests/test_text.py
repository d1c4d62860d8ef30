import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("POST /v2/avatar_start 错误码11200 v3 étion foo_bar", ["/v2/avatar_start", "11200", "2", "3", "avatar", "post", "start", "v2", "v2", "v3", "错误", "错误码", "误码"]),
        ("", []), ("中", []), ("42 7", ["42", "7"]), (None, []),
    ],
)
def test_tokens(spark, text, want):
    assert sorted(one(spark, text, X.tokenize)) == sorted(want)


def test_names_and_ids(spark):
    assert set(one(spark, "接口 v2.1 guide", X.name_tokens)) >= {"v2.1", "2.1", "v2", "接口", "guide"}
    assert [one(spark, t, X.has_exact_id) for t in ("code 5", "a/b", "12345", "hello 12", "", None)] == [True, True, True, False, False, False]


CLAIMS = [("Java 21 发布", True), ("截至 2026 年 1 月", True), ("该公司成立于 2010 年", False), ("最新版本增加了虚拟线程支持", False), ("dev. build", True), ("nothing here", False), ("2025-11 起", True)]


@pytest.mark.parametrize(("text", "risk"), CLAIMS)
def test_claims(spark, text, risk):
    got = one(spark, text, lambda c: X.time_sensitive_claims(c, 2026))
    assert got["has_risk"] == risk and (not risk or got["confidence"] == "high")


def test_strict_claims(spark):
    got = one(spark, "最近 latest 500万", lambda c: X.time_sensitive_claims(c, 2026, strict=True))
    assert got["confidence"] == "medium" and set(got["signals"]) == {"latest_keyword", "time_adverb", "specific_data"}


def test_claims_look_for_versions_once(spark):
    """Text is searched once for each pattern and put into small letters once, however many fields are named."""
    df = spark.createDataFrame([("Java 21 is the LATEST, v1.2 ſ Vue\n3 since 2025-11",), ("a.1 v. x",), ("",), (None,)], "t string")
    out = df.select(X.time_sensitive_claims(F.col("t"), 2026).alias("c")).select("c.*")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and plan.count("lower(") == 1
    assert [tuple(r) for r in out.collect()] == [(True, ["version", "recent_date", "latest_keyword"], ["Java 21", "v1.2", "2025-11"], "high"), (True, ["version"], ["v."], "high"), (False, [], [], "low"), (False, [], None, "low")]
    any_ = df.select(F.regexp_extract_all("t", F.lit(X.VERSION), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(X.VERSION_FAST), F.lit(0)).alias("b"))
    assert all(r["a"] == r["b"] for r in any_.collect())


def test_heading_level(spark):
    make = lambda a, b, c: "\n".join(["## x"] * a + ["### y"] * b + ["#### z"] * c)
    assert [one(spark, make(*n), X.detect_heading_level) for n in ((3, 8, 10), (0, 0, 0), (3, 2, 0), (2, 9, 1))] == [4, 3, 2, 3]


def test_urls(spark):
    assert one(spark, "a.org/x/#f", X.normalize_url) == "https://a.org/x"
    parse = lambda u: tuple(one(spark, u, X.parse_doc_url))
    assert parse("https://x.cn/wiki/abc?y=1") == ("wiki", "abc") and parse("https://x.cn/docx/abc") == ("docx", "abc") and parse("tok?x#y") == ("wiki", "tok")
    assert one(spark, "see 《A》[doc_id:12] and 《B》[doc_id:3]", X.extract_citations) == [("A", 12), ("B", 3)]


def test_cleaning(spark):
    assert one(spark, "a b​c\u0007d\te", X.clean_pdf_text) == "a bcd e"
    assert one(spark, "x" * 100 + "\n \n\n\n" + "y", X.collapse_blank_lines) == "x" * 100 + "\n\ny"
    assert one(spark, "## Title that is rather long for a name\nz", lambda c: X.title_from_text(c, F.lit("f"))) == "Title that is rather long for ....md"
    assert one(spark, "\n# \n", lambda c: X.title_from_text(c, F.lit("f"))) == "f.md"
    assert one(spark, "POST /a/b\n这是一个足够长的说明文字行", lambda c: X.make_summary(c, F.lit("T"))) == "T — /a/b — 这是一个足够长的说明文字行"
    assert one(spark, "# a\n\n\n\n [TOC] \nb ", X.postprocess_lines) == "# a\n\nb"


def test_texts_are_made_small_once(spark):
    """all patterns go over one small-letter copy of a text."""
    assert spark.createDataFrame([("a",)], "t string").select(X.tokenize(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1

"""Answer quality: citations that lead nowhere, policies over turns, evaluation against expected keywords."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import extract_citations, has_doc_cite, has_url_cite, time_sensitive_claims

SEVERITIES = ["low", "medium", "high", "blocked"]


class Policy(NamedTuple):
    """A named condition over the columns of a turn, with what it says when it holds."""

    name: str
    severity: str
    broken: Column
    message: str


def default_policies(current_year: int) -> list[Policy]:
    c = F.col
    risky = time_sensitive_claims(c("answer"), current_year)["has_risk"]
    said = F.coalesce(c("answer"), F.lit("")) != ""  # without an answer nothing is missing in it
    return [
        Policy("unsupported_claim", "high", c("kb_retrieve_done") & ~c("kb_has_coverage") & ~c("web_used") & risky, "time-sensitive claim without any source"),
        Policy("missing_doc_cite", "medium", said & c("kb_has_coverage") & ~has_doc_cite(c("answer")), "covered by documents but none is cited"),
        Policy("missing_url_cite", "medium", said & c("web_used") & ~has_url_cite(c("answer")), "web results without a link or a note"),
        Policy("web_before_kb", "blocked", c("web_used") & (~c("kb_retrieve_done") | c("kb_has_coverage")), "web search before or despite the knowledge base"),
    ]


def audit_answers(turns: DataFrame, policies: list[Policy], min_severity: str = "high") -> DataFrame:
    """CJ5: (thread_id, turn, policy, severity, message) of every policy broken at min_severity or above."""
    keep = [p for p in policies if SEVERITIES.index(p.severity) >= SEVERITIES.index(min_severity)]
    found = F.array_compact(F.array(*[F.when(p.broken, F.struct(F.lit(p.name).alias("policy"), F.lit(p.severity).alias("severity"), F.lit(p.message).alias("message"))) for p in keep]))
    return turns.select("thread_id", "turn", F.inline(found))


def dangling_citations(answers: DataFrame, docs: DataFrame, hits: DataFrame) -> DataFrame:
    """JN15: (thread_id, turn, doc_id, reason): cited documents that do not exist or were not among the turn's hits."""
    cited = answers.select("thread_id", "turn", F.explode(extract_citations(F.col("answer"))).alias("c")).select("thread_id", "turn", "c.doc_id").distinct()
    lost = cited.join(docs.select("doc_id"), "doc_id", "left_anti").withColumn("reason", F.lit("no such document"))
    unseen = cited.join(docs.select("doc_id"), "doc_id", "left_semi").join(hits.select("thread_id", "turn", "doc_id").distinct(), ["thread_id", "turn", "doc_id"], "left_anti").withColumn("reason", F.lit("not retrieved"))
    cols = ["thread_id", "turn", "doc_id", "reason"]
    return lost.select(*cols).unionByName(unseen.select(*cols))


def score_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """AG7: (id, category, score, matched_keywords, total_keywords); no keywords give no score."""
    j = questions.join(answers.select("id", "answer"), "id")
    hit = F.filter("expected_answer_keywords", lambda k: F.contains(F.col("answer"), k))
    n = F.size(F.coalesce("expected_answer_keywords", F.array().cast("array<string>")))
    return j.select("id", "category", F.when(n > 0, F.size(hit) / n).alias("score"), hit.alias("matched_keywords"), n.alias("total_keywords"))


def summarise(scores: DataFrame) -> DataFrame:
    """AG8: (category, avg_score, n), the null category for all; categories without any score are left out."""
    return scores.where("score is not null").rollup("category").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n"))


def round_metrics(turns: DataFrame) -> DataFrame:
    """AG9: (round, retrieval_rate, warning_rate, mean_ms)."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return turns.groupBy("round").agg(rate("retrieved").alias("retrieval_rate"), rate("warned").alias("warning_rate"), F.avg("response_ms").alias("mean_ms"))


def evaluate(questions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CJ6."""
    scores = score_answers(questions, answers)
    return scores, summarise(scores)

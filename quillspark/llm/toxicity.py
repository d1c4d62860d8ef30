"""Toxicity by a classifier chain: linear models in turn, each fed the probabilities of those before it."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, spare_names, stage_table

#: Labelled rows used for fitting, by rising hash of the id: bounds the fit, and what the driver holds, at any size.
FIT_ROWS = 10_000
FOLDS = 3
FEATURES = 1 << 17
CHAIN = ("quality", "toxic")


def features(text) -> F.Column:
    """Hashes of the distinct beginnings, of four and of six letters, of the words of the whole text, lower-cased."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda x: x != "")
    at = lambda n: F.transform(w, lambda x: F.pmod(F.xxhash64(F.substring(x, 1, n), F.lit(n)), F.lit(FEATURES)).cast("int"))
    return F.array_distinct(F.concat(at(4), at(6)))


class Linear(NamedTuple):
    """Weights of the hashed features, of the logits of earlier categories, and the intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margin(self, docs: Rows, logits: np.ndarray) -> np.ndarray:
        return docs.sums(self.weights) + logits @ self.earlier + self.bias


class Rows(NamedTuple):
    """Documents as runs of feature numbers."""

    index: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, lists) -> Rows:
        parts = [np.asarray(x, np.int32) for x in lists]
        return cls(np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(p) for p in parts], np.int64))

    def sums(self, w: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0.0], np.cumsum(w[self.index], dtype=float)))
        end = np.cumsum(self.length)
        return run[end] - run[end - self.length]

    def take(self, rows: np.ndarray) -> Rows:
        end = np.cumsum(self.length)
        return Rows.of([self.index[end[r] - self.length[r] : end[r]] for r in rows])


def fit_linear(docs: Rows, logits: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.15, batch: int = 128, seed: int = 42) -> Linear:
    """Logistic regression by AdaGrad in a seeded order; the mean of the weights over the last half is kept."""
    rng = np.random.default_rng(seed)
    w, e, b = np.zeros(FEATURES), np.zeros(logits.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, ge, gb = np.full(FEATURES, 1e-2), np.full(logits.shape[1], 1e-2), 1e-2
    mean, steps = np.zeros(FEATURES), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            part = docs.take(rows)
            p = 1 / (1 + np.exp(-np.clip(part.sums(w) + logits[rows] @ e + b, -30, 30)))
            err = (p - y[rows]) / len(rows)
            g = np.bincount(part.index, weights=np.repeat(err, part.length), minlength=FEATURES)
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            g = err @ logits[rows]
            ge += g * g
            e -= rate * g / np.sqrt(ge)
            gb += err.sum() ** 2
            b -= rate * err.sum() / np.sqrt(gb)
        if epoch >= epochs // 2:
            mean, steps = mean + w, steps + 1
    return Linear((mean / steps).astype(np.float32), e, float(b))


class Chain(NamedTuple):
    """The fitted models of a chain, in order, and the threshold on the last category's probability."""

    categories: tuple[str, ...]
    models: tuple[Linear, ...]
    threshold: float

    def probabilities(self, lists) -> np.ndarray:
        docs = Rows.of(lists)
        logits = np.zeros((len(docs.length), 0))
        for m in self.models:
            logits = np.column_stack([logits, np.clip(m.margin(docs, logits[:, : len(m.earlier)]), -8, 8)])
        return 1 / (1 + np.exp(-logits))

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with a column p_<category> for each category: one pass over the texts, no shuffle.

        Words are hashed in the JVM; the weights, of fixed size, go to the executors once.
        """
        model = df.sparkSession.sparkContext.broadcast(self)
        (out,) = spare_names(df, "tox_p")
        names = [f"p{i}" for i in range(len(self.categories))]

        @F.pandas_udf(", ".join(f"{n} double" for n in names))
        def run(words: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(model.value.probabilities(words), columns=names)

        scored = df.withColumn(out, run(features(F.col(text))))
        return scored.withColumns({f"p_{c}": F.col(f"{out}.{n}") for c, n in zip(self.categories, names, strict=True)}).drop(out)


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CHAIN, fit_rows: int = FIT_ROWS, folds: int = FOLDS, text: str = "text", seed: int = 42) -> Chain | None:
    """The chain for labels (doc_id and a 0/1 column for each category), None if a category has not both values.

    At most fit_rows labelled documents are read, by hash of the id. The probabilities of a category that later models
    and the threshold learn from are out of fold: of models that have not seen the document. Rows of labels that repeat
    an id count once, with their largest values; null labels and ids are left out, and so are labels without a document.
    """
    per = labels.where(" and ".join(f"{c} is not null" for c in ("doc_id", *categories))).groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(f"y_{c}") for c in categories])
    per = per.withColumn("tox_o", F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))).orderBy("tox_o").limit(fit_rows)
    train = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(per), "doc_id")  # fit_rows rows at most
    train = stage_table(train.select("tox_o", features(F.col("text")).alias("words"), *[f"y_{c}" for c in categories]), "train")
    sample = train.orderBy("tox_o").limit(fit_rows).toArrow()  # repeated documents add no rows beyond the bound
    words = sample["words"].combine_chunks()
    rows = Rows(words.flatten().to_numpy(), np.diff(words.offsets.to_numpy()).astype(np.int64))
    fold = (sample["tox_o"].to_numpy() % folds).astype(int)
    logits, models = np.zeros((len(fold), 0)), []
    for c in categories:
        y = sample[f"y_{c}"].to_numpy().astype(float)
        if any(len(np.unique(y[fold != k])) < 2 for k in range(folds)):
            return None
        models.append(fit_linear(rows, logits, y))
        unseen = np.zeros(len(y))
        for k in range(folds):
            seen, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            unseen[rest] = fit_linear(rows.take(seen), logits[seen], y[seen]).margin(rows.take(rest), logits[rest])
        logits = np.column_stack([logits, np.clip(unseen, -8, 8)])
    p = 1 / (1 + np.exp(-logits[:, -1]))
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    low = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return Chain(tuple(categories), tuple(models), float((p[order[best]] + low) / 2))


def score_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs with p_<category> for each category and is_toxic, by the threshold with the best out-of-fold F1.

    Without labels to learn from, probabilities are null and nothing is toxic. Null and empty texts have no words and
    so the base rate; repeated rows score alike. Columns of docs named like a result are replaced; others stay.
    """
    categories = kw.get("categories", CHAIN)
    docs = docs.drop("is_toxic", *[f"p_{c}" for c in categories])
    chain = fit_chain(docs, labels, **kw)
    if chain is None:
        return docs.withColumns({**{f"p_{c}": F.lit(None).cast("double") for c in categories}, "is_toxic": F.lit(False)})
    return chain.score(docs).withColumn("is_toxic", F.col(f"p_{categories[-1]}") >= chain.threshold)

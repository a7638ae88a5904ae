"""Toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - b_k) with one weight vector for all thresholds
b_0 < b_1 < ... over the ranks of the grades that the sample holds; a grade's
probability is the difference of its neighbours, and the fit maximises the
likelihood of the grades. The expected severity is the mean of the grades, in
their own units, under these probabilities.
Features are sparse: which words, and which four- and five-letter word
beginnings, of a vocabulary chosen on the training sample, the text contains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import sample_rows

#: Bounds of the training sample and of the model.
SAMPLE_PER_CLASS = 4000
VOCABULARY = 1024
MOST_GRADES = 64
WORD = re.compile(r"[^\W\d_]+")


def grams(text: str) -> set[str]:
    """The distinct features of a text: lower-cased words, and word beginnings with a closing star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


@dataclass
class SeverityModel:
    names: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray  # rising, one less than the grades
    grades: np.ndarray  # rising

    def rows(self, texts: list[str]) -> list[list[int]]:
        names = self.names
        return [[names[g] for g in grams(t) & names.keys()] for t in texts]

    def expected(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and the most probable grade."""
        p = probabilities(np.array([self.weights[r].sum() for r in rows]), self.cuts)
        return p @ self.grades, self.grades[p.argmax(1)]


def probabilities(eta: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The probability of each rank, by scores and cuts."""
    over = 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts[None, :], -30, 30)))
    return -np.diff(np.hstack([np.ones((len(eta), 1)), over, np.zeros((len(eta), 1))]), axis=1)


def likelihood(w: np.ndarray, cuts: np.ndarray, rows: list[list[int]], ranks: np.ndarray, share: np.ndarray) -> float:
    """The weighted log likelihood of the ranks."""
    p = probabilities(np.array([w[r].sum() for r in rows]), cuts)
    return float((share * np.log(np.maximum(p[np.arange(len(ranks)), ranks], 1e-12))).sum())


def shares(ranks: np.ndarray, levels: int) -> np.ndarray:
    """Weights by which every rank counts alike."""
    share = 1 / np.bincount(ranks, minlength=levels + 1).clip(1)[ranks]
    return share / share.sum()


def fit_cumulative_link(rows: list[list[int]], ranks: np.ndarray, dims: int, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cuts that maximise the cumulative-link likelihood of the ranks 0, 1, ..., by accelerated full-batch descent.

    The cuts are the first one and the logarithms of the steps to the others, so
    they rise strictly. Every rank counts alike in the mean.
    """
    levels = int(ranks.max(initial=0)) if len(ranks) else 0
    w, first, steps = np.zeros(dims), 0.5, np.full(max(0, levels - 1), np.log(1 / max(1, levels - 1)))
    cuts = lambda: first + np.r_[0.0, np.cumsum(np.exp(steps))]
    if not levels:
        return w, cuts()
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=np.int64)
    share, each = shares(ranks, levels), np.arange(len(rows))
    theta = np.r_[w, first, steps]
    v, g2 = np.zeros(len(theta)), np.full(len(theta), 1e-8)
    for t in range(rounds):
        w, first, steps = theta[:dims], theta[dims], theta[dims + 1 :]
        eta = np.bincount(doc, weights=w[col], minlength=len(rows))
        over = np.hstack([np.ones((len(rows), 1)), 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts()[None, :], -30, 30))), np.zeros((len(rows), 1))])
        slope = over * (1 - over)  # of the sigmoids; zero at both ends
        p = np.maximum(over[each, ranks] - over[each, ranks + 1], 1e-12)
        at_low, at_high = share * slope[each, ranks] / p, share * slope[each, ranks + 1] / p
        g_eta = at_high - at_low
        g_cut = np.bincount(ranks, weights=-at_high, minlength=levels + 1)[:levels] + np.bincount(ranks, weights=at_low, minlength=levels + 1)[1:]
        behind = np.cumsum(g_cut[::-1])[::-1]  # a step moves all cuts behind it
        g = np.r_[np.bincount(col, weights=g_eta[doc], minlength=dims) + l2 * w, behind[0], np.exp(steps) * behind[1:]]
        g2 = 0.99 * g2 + 0.01 * g**2
        v = 0.9 * v + 0.1 * g
        theta = theta - 0.05 * (1 - t / rounds) * v / np.sqrt(g2)
    w, first, steps = theta[:dims], theta[dims], theta[dims + 1 :]
    return w, cuts()


def fit_severity(labelled: DataFrame, id_col: str, text_col: str, grade_col: str, per_grade: int = SAMPLE_PER_CLASS, vocabulary: int = VOCABULARY, grades: DataFrame | None = None) -> SeverityModel | None:
    """The model from graded rows; None without two grades, ValueError for more than MOST_GRADES.

    Grades are any whole numbers, negative and far apart ones too: the fit goes by their ranks.

    ``grades``: a table of ``id_col`` and ``grade_col``, if ``labelled`` has texts
    only; then the texts aren't shuffled to meet their grades.

    A threshold a grade above the lowest; no grade is invented, so labels 0 and 1
    give one threshold and a severity from 0 to 1.

    Sample: of each grade the ``per_grade`` ids that hash lowest, one row an id.
    Vocabulary: the features that most exceed, in standard deviations, the number
    of documents above the lowest grade that chance would give them; at most ``vocabulary``.
    """
    key = F.col(id_col).cast("long").alias("id")
    graded = (labelled if grades is None else grades).select(key, F.col(grade_col).cast("int").alias("grade"), *([F.col(text_col).alias("text")] if grades is None else [])).where("id is not null and grade is not null")
    if grades is None:
        picked = sample_rows(graded.where("text is not null"), per_grade, "grade", MOST_GRADES)
    else:
        texts = labelled.select(key, F.col(text_col).alias("text")).where("id is not null and text is not null")
        picked = sample_rows(graded.join(texts.select("id").distinct(), "id", "left_semi"), per_grade, "grade", MOST_GRADES, texts)
    if picked is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array([sorted(grams(t.as_py())) for t in part.column(2)], pa.list_(pa.string()))], names=["id", "grade", "grams"])

    sample = picked.mapInArrow(run, "id long, grade int, grams array<string>").persist()
    many = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    if len(many) < 2:
        sample.unpersist()
        return None
    values = np.array(sorted(many))
    low = int(values[0])
    clean, bad = many[low], sum(many.values()) - many[low]
    per = sample.select("grade", F.explode("grams").alias("g")).groupBy("g").agg(F.sum((F.col("grade") > low).cast("long")).alias("b"), F.sum((F.col("grade") == low).cast("long")).alias("c")).where("b + c >= 3")
    due = (F.col("b") + F.col("c")) * bad / (bad + clean)
    names = {r["g"]: i for i, r in enumerate(per.orderBy(((F.col("b") - due) / F.sqrt(due + 1)).desc(), "g").limit(vocabulary).collect())}
    held = sample.sparkSession.sparkContext.broadcast(names)  # at most ``vocabulary`` words

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[held.value[g] for g in x if g in held.value] for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["id", "grade", "cols"])

    got = sample.mapInArrow(narrow, "id long, grade int, cols array<int>").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    sample.unpersist()
    cols, grades = got["cols"].to_pylist(), got["grade"].to_numpy()
    return SeverityModel(names, *fit_cumulative_link(cols, np.searchsorted(values, grades), max(1, len(names))), values)


def score_severity(docs: DataFrame, model: SeverityModel | None, id_col: str = "doc_id", text_col: str = "text", flag_at: float = 0.5) -> DataFrame:
    """(id, expected_severity, grade, toxic) per row of ``docs``; toxic: expected severity of ``flag_at`` or more, in the units of the grades.

    Null, empty and wordless texts, and those without a known feature, have the
    lowest grade; everything has 0 where no model could be fitted. Whole texts are read; repeated rows stay; extra
    columns are ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t.as_py() or "" for t in batch.column(1).slice(at, 256)]
                severity, grade = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
                if m:
                    rows = m.rows(texts)
                    has = np.array([bool(r) for r in rows])
                    e, g = m.expected(rows)
                    severity, grade = np.where(has, e, m.grades[0]).astype(float), np.where(has, g, m.grades[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(severity >= flag_at)], names=["id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, expected_severity double, grade int, toxic boolean")

"""Language identification: family first, then one-versus-one linear SVMs.

Features are counts of hashed character 1- to 3-grams over the whole lower-cased
text, square-rooted and scaled to length one. A linear one-versus-rest SVM
picks the family; inside a family every pair of languages has its own linear
SVM, and the votes, weighted by their margins, decide.

The models are fitted on a bounded sample: at most ``per_lang`` training
documents of each language, the ones whose ids hash lowest, one row an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .narrow import keep_rows

DIMS = 1 << 12
#: Families of languages by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "sinitic": "yue zh",
}
UNKNOWN = "und"
BLOCK = 4_000_000
MOST_LANGS = 1000


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own.split()), lang)


def features(texts: list[str]) -> np.ndarray:
    """A float32 row of DIMS hashed gram weights per text; no cased or other letters: zeros."""
    counts = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):  # whole text, in blocks that overlap by two characters
            x = np.frombuffer(f" {text[max(0, at - 2) : at + BLOCK].lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
            x[(x < 65) | ((x > 90) & (x < 97)) | ((x > 122) & (x < 170))] = 32  # digits, signs and spaces are one border
            x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
            one = x * np.uint32(0x9E3779B1)
            two = (one[:-1] ^ (x[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35) if len(x) > 1 else x[:0]
            three = (two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1) if len(x) > 2 else x[:0]
            for h in (one, two, three):
                counts[i] += np.bincount(h >> np.uint32(20), minlength=DIMS)
    np.sqrt(counts, out=counts)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.maximum(norm, 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, of an L2-regularised squared-hinge SVM by dual coordinate descent in a fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    q = (x.astype(np.float64) ** 2).sum(1) + 0.5 / c
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / q[i])
            if d := new - alpha[i]:
                w += d * y[i] * x[i]
                alpha[i], moved = new, max(moved, abs(d))
        if moved < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    families: list[str]
    langs: list[str]
    by_family: np.ndarray  # one row of weights per family
    pairs: list[tuple[int, int]]  # of languages of one family, the first is the positive side
    by_pair: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, langs_of: list[str]) -> LanguageModel:
        langs = sorted(set(langs_of))
        own = [family_of(lang) for lang in langs]
        families = sorted(set(own))
        y = np.array([langs.index(lang) for lang in langs_of])
        fam = np.array([families.index(own[i]) for i in range(len(langs))], dtype=int)
        zero = np.zeros((0, DIMS + 1))
        by_family = np.vstack([zero, *[linear_svm(x, np.where(fam[y] == f, 1.0, -1.0)) for f in range(len(families))]]) if len(families) > 1 else np.zeros((len(families), DIMS + 1))
        pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if fam[a] == fam[b]]
        by_pair = np.vstack([zero, *[linear_svm(x[m], np.where(y[m] == a, 1.0, -1.0)) for a, b in pairs for m in [(y == a) | (y == b)]]])
        return cls(families, langs, by_family, pairs, by_pair)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers, and scores in 0 to 1: the family's probability times the mean of the language's own pairwise probabilities, whatever the family's size."""
        fam_of = np.array([self.families.index(family_of(lang)) for lang in self.langs])
        margin = x @ self.by_family[:, :-1].T + self.by_family[:, -1]
        p = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
        p /= p.sum(1, keepdims=True)
        votes = np.zeros((len(x), len(self.langs)))
        if self.pairs:
            side = 1 / (1 + np.exp(-np.clip(3 * (x @ self.by_pair[:, :-1].T + self.by_pair[:, -1]), -30, 30)))
            for k, (a, b) in enumerate(self.pairs):
                votes[:, a] += side[:, k]
                votes[:, b] += 1 - side[:, k]
        size = np.array([(fam_of == f).sum() for f in fam_of])
        votes = np.where(size > 1, votes / np.maximum(size - 1, 1), 1.0)
        best = p.argmax(1)
        votes = np.where(fam_of[None, :] == best[:, None], votes, -1.0)
        lang = votes.argmax(1)
        return lang, np.clip(p.max(1) * votes.max(1), 0.0, 1.0)


def sampled(train: DataFrame, per_label: int, label: str, most: int) -> DataFrame | None:
    """(label, id) of at most ``per_label`` ids of each label, lowest hash first; None without a label.

    Equal ids of a label are one first, so neither repeated rows nor the rows of
    one id push a label out or add to the sample. A cut of the hash by the
    label's number of ids leaves about half as many again as are wanted, whatever
    the input, and only those are ranked. Over ``most`` labels raise ValueError.
    """
    ids = train.select(label, "id").distinct()
    counts = ids.groupBy(label).count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} values of {label}")
    if not counts:
        return None
    cut = {r[label]: min((1 << 63) - 1, int(min(1.0, (1.5 * per_label + 64) / r["count"]) * (1 << 64)) - (1 << 63)) for r in counts}
    cuts = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
    some = ids.withColumn("h", F.xxhash64("id")).where(F.col("h") <= cuts[F.col(label)])
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy("h", "id")))
    return ranked.where(F.col("r") <= per_label).select(label, "id")


def sample_rows(train: DataFrame, per_label: int, label: str, most: int, texts: DataFrame | None = None) -> DataFrame | None:
    """One row (label, id, text) for each of ``sampled``: of rows that share both, the one whose text hashes lowest.

    ``texts(id, text)``: where the texts are, if ``train`` has labels only; no text is shuffled but the sample's.
    """
    picked = sampled(train, per_label, label, most)
    if picked is None:
        return None
    # At most per_label * most small rows are broadcast.
    rows = train.join(F.broadcast(picked), [label, "id"]) if texts is None else texts.join(F.broadcast(picked), "id")
    return rows.groupBy(label, "id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("low")).select(label, "id", F.col("low.text").alias("text"))


def fit_languages(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500) -> LanguageModel | None:
    """The model from labelled rows; None if there is none. Rows with a null id, text or language don't teach.

    The model has a row of weights a family, at most MOST_LANGS, and one a pair
    of languages of a listed family, a few hundred whatever the data: a language
    that FAMILIES doesn't list is a family of its own.
    """
    rows = train.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    sample = sample_rows(rows, per_lang, "lang", MOST_LANGS)
    if sample is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t.as_py() for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["id", "lang", "x"])

    got = sample.mapInArrow(run, "id long, lang string, x binary").toArrow().sort_by([("id", "ascending"), ("lang", "ascending")])
    x = np.vstack([np.frombuffer(b, dtype=np.float16) for b in got["x"].to_pylist()]).astype(np.float32)
    return LanguageModel.fit(x, got["lang"].to_pylist())


def judge(texts: list[str | None], model: LanguageModel | None) -> tuple[list[str], list[float]]:
    """Language and score per text; ``und`` and 0 without a letter or a model."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model and (has := [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]):
        best, p = model.predict(features([texts[i] for i in has]))
        for i, b, s in zip(has, best, p, strict=True):
            lang[i], score[i] = model.langs[b], float(s)
    return lang, score


def predict_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row of ``docs``.

    lang_pred is ``und`` and score 0 where the text is null or has no letter (by
    Unicode), or where there is no model. Texts of any length are used whole;
    repeated rows and null ids come back as they are; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is the number of languages, families and pairs times DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lang, score = judge(batch.column(1).slice(at, 256).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: LanguageModel | None, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with a language of at least the score. Nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: [lang != UNKNOWN and s >= least_score for lang, s in zip(*judge(texts, held.value), strict=True)])

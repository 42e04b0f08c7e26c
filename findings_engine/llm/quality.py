"""Operator 7: a quality classifier by co-training of two views of a document.

- The text view counts what the text is made of: shares of each byte and of classes of characters, repeated
  words and neighbours, lengths of words.
- The metadata view knows the page's record alone: language, source (both hashed, and together), and length.

Both views of every document are worked out once, in Arrow batches, and written down; all that follows reads those numbers.
Each view's classifier is a logistic regression. From labelled rows of the training folds (at most TRAIN_ROWS, the
first in a hashed order) both start. In each of ROUNDS rounds each view labels every row without a label that it is sure of,
CONFIDENT at least, but for those of which the other is as sure of the opposite, and the other view makes a Newton step on
those labels and its own. All such rows count, however many: the sums of the step are added up in tasks, and together they weigh
PSEUDO_WEIGHT of the labelled rows, in the proportion of the labels. A weak view's errors would
otherwise drown a strong one: it teaches only as far as rows that it has not learned from bear it out. Then each is calibrated on
labelled rows that it has not learned from (a logistic regression of its log-odds), and a last one combines both calibrated
log-odds. All rows are scored.

Nulls: a null text is empty, null metadata is a value of its own. Null ids count as not held out, and as rows without a label.
Without labels of both kinds the score is the smoothed rate. Of repeated rows of a labelled id one teaches, the first by its
numbers; all are scored. An empty table gives none. Texts may be of any length: a document's numbers are of fixed size. Only the
named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, forget, held_out, pieces, table, written
from .logistic import Logistic, fit, newton_step, sums

TRAIN_ROWS = 6_000
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 3, 0.95, 0.3
#: A view hands a label over only as far as it was right so often on at least so many rows that it has not learned from.
TRUSTED, LEAST_ROWS = 0.98, 5
#: A document is kept from this probability of good quality on.
THRESHOLD = 0.5
#: Buckets for languages, for sources and for both together; tasks that add up the sums of a step.
BUCKETS, ADDERS = 16, 16
META = ("lang", "source", "n_chars")
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def text_view(raw: bytes) -> list[float]:
    n = max(len(raw), 1)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    m = max(len(words), 1)
    lower = [w.lower() for w in words]
    same = sum(map(bytes.__eq__, lower, lower[1:]))
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    edges = sum(w[-1] in _PUNCTUATION and w[-1] not in b".,;:" for w in words)
    groups = [histogram[65:91].sum(), histogram[97:123].sum(), histogram[48:58].sum(), histogram[128:].sum(), histogram[list(_PUNCTUATION)].sum()]
    shape = [len(set(lower)) / m, same / m, pairs / m, edges / m, math.log1p(n / m), sum(len(w) == 1 for w in words) / m, float(not words)]
    rare = np.sqrt(histogram[list(_PUNCTUATION) + [9, 10, 13, 32]])
    return [*groups, *shape, *rare]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (3 * BUCKETS)
    for k, key in enumerate((lang or "\0", source or "\0", f"{lang}\0{source}")):
        out[k * BUCKETS + zlib.crc32(key.encode()) % BUCKETS] = 1.0
    size = math.log1p(max(n_chars or 0, 0))
    return [*out, float(n_chars is None), size, size * size / 10, float(size < 4), float(size < 6)]


@dataclass(frozen=True)
class Model:
    views: tuple[Logistic, Logistic]
    calibration: tuple[Logistic, Logistic]
    combined: Logistic

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = [c.log_odds(v.log_odds(x)[:, None]) for c, v, x in zip(self.calibration, self.views, (text, meta), strict=True)]
        return self.combined.probability(np.stack(z, axis=1))


def trusted(score: np.ndarray, right: np.ndarray) -> float:
    """The least score, CONFIDENT or more, from which on a view was right so often on rows it has not learned from; else infinity."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / (np.arange(len(order)) + 1)
    fit_for = np.flatnonzero((share >= TRUSTED) & (score[order] >= CONFIDENT))
    return float(score[order][fit_for[-1]]) if len(fit_for) and fit_for[-1] + 1 >= LEAST_ROWS else math.inf


def _sure(p: tuple[np.ndarray, np.ndarray], least: list[dict[int, float]]) -> list[dict[int, np.ndarray]]:
    """Of each view and label the rows that it hands over."""
    out = []
    for k in (0, 1):
        of = lambda label, x: x if label else 1 - x
        out.append({label: (of(label, p[k]) >= least[k][label]) & (of(label, p[1 - k]) > 1 - CONFIDENT) for label in (1, 0)})
    return out


def co_train(views: tuple[np.ndarray, np.ndarray], good: np.ndarray, pool_sums, rounds: int = ROUNDS) -> Model:
    """``views``: labelled rows of each view; every fourth only calibrates.

    ``pool_sums(models, least)`` gives, for each view, of each label the rows that the other view hands over: their
    number and the sums of a Newton step on them.
    """
    calibrates = np.arange(len(good)) % 4 == 3
    y = good[~calibrates]
    x = [v[~calibrates] for v in views]
    models = [fit(a, y) for a in x]
    rate = y.mean() if len(y) else 0.5
    held = [v[calibrates] for v in views]
    for _ in range(rounds if len(y) and 0 < rate < 1 else 0):
        known = [m.probability(h) for m, h in zip(models, held, strict=True)]
        right = lambda k, label: trusted(known[k] if label else 1 - known[k], good[calibrates] == label)
        least = [{label: right(k, label) for label in (1, 0)} for k in (0, 1)]
        if all(math.isinf(v) for of in least for v in of.values()):
            break
        handed = pool_sums(models, least)
        for k, m in enumerate(models):
            parts = [sums(m, x[k], y)]
            for label, share in ((1, rate), (0, 1 - rate)):
                n, of = handed[k][label]
                if n:
                    scale = min(1.0, PSEUDO_WEIGHT * len(y) * share / n)
                    parts.append(tuple(scale * part for part in of))
            models[k] = replace(m, weights=newton_step(m.weights, [sum(p) for p in zip(*parts, strict=True)]))
    truth = good[calibrates] if calibrates.any() else good
    odds = [m.log_odds(v[calibrates] if calibrates.any() else v) for m, v in zip(models, views, strict=True)]
    calibration = tuple(fit(z[:, None], truth) for z in odds)
    combined = fit(np.stack([c.log_odds(z[:, None]) for c, z in zip(calibration, odds, strict=True)], axis=1), truth)
    return Model((models[0], models[1]), calibration, combined)


N_TEXT, N_META = len(text_view(b"")), len(meta_view(None, None, None))


def _views(texts: list[bytes], meta: list[tuple]) -> np.ndarray:
    """A row of both views' numbers for each document, in single precision."""
    return np.array([text_view(t) + meta_view(*m) for t, m in zip(texts, meta, strict=True)], np.float32).reshape(-1, N_TEXT + N_META)


def _of(batch: pa.RecordBatch, text_col: str, meta: tuple[str, str, str]) -> np.ndarray:
    return _views([t.as_py() or b"" for t in batch.column(text_col).cast(pa.binary())], list(zip(*(batch.column(c).to_pylist() for c in meta), strict=True)))


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :N_TEXT].astype(float), x[:, N_TEXT:].astype(float)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in batch.column("views")), "<f4").reshape(-1, N_TEXT + N_META)


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, str, str] = META) -> DataFrame:
    """id and ``views``: both views' numbers (single precision, little-endian), the text's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            rows = _of(batch, text_col, meta).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "views"])

    return df.select(*dict.fromkeys([id_col, text_col, *meta])).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, views binary")


def pool_sums(pool: DataFrame):
    """The sums that ``co_train`` asks for, over all rows of ``pool`` (views): each task adds up its own, ADDERS tasks add those up."""
    width = lambda n: 1 + (n + 1) + (n + 1) ** 2
    sizes = [(k, label, n) for k, n in ((0, N_TEXT), (1, N_META)) for label in (1, 0)]
    total = sum(width(n) for _, _, n in sizes)

    def asked(models: list[Logistic], least: list[dict[int, float]]) -> list[dict[int, tuple]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            out = np.zeros(total)
            for batch in batches:
                x = _split(_numbers(batch))
                chosen = _sure(tuple(m.probability(v) for m, v in zip(models, x, strict=True)), least)
                at = 0
                for k, label, n in sizes:
                    rows = x[k][chosen[1 - k][label]]
                    gradient, hessian = sums(models[k], rows, np.full(len(rows), label))
                    out[at : at + width(n)] += np.concatenate([[len(rows)], gradient, hessian.ravel()])
                    at += width(n)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % ADDERS], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "sums"])

        def add(group: pa.Table) -> pa.Table:
            out = sum(np.frombuffer(v.as_py()) for v in group.column("sums"))
            return pa.table({"sums": pa.array([out.tobytes()], pa.binary())})

        rows = pool.select("views").mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "sums binary").collect()
        out, at, found = sum((np.frombuffer(bytes(r.sums)) for r in rows), np.zeros(total)), 0, [{}, {}]
        for k, label, n in sizes:
            part = out[at : at + width(n)]
            found[k][label] = (int(part[0]), (part[1 : n + 2], part[n + 2 :].reshape(n + 1, n + 1)))
            at += width(n)
        return found

    return asked


def train(numbers: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """``numbers``: id and views, cheap to read again. ``labels``: id and quality (1 good)."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.min("quality").alias("quality"))
    rows = numbers.join(known, F.col("id") == F.col("_of"), "left")
    pool = written(rows.filter("_of is null").select("views"), "pool")
    chosen = known.filter(F.col("quality").isNotNull() & ~held_out(F.col("_of")))
    wanted = bounded_sample(chosen.join(numbers.select(F.col("id").alias("_of")).distinct(), "_of", "left_semi"), "_of", TRAIN_ROWS)
    labelled = numbers.join(F.broadcast(wanted), F.col("id") == F.col("_of"))  # TRAIN_ROWS narrow rows at most
    found = labelled.groupBy("id").agg(F.min("views").alias("views"), F.first("quality").alias("quality")).select(F.xxhash64("id").alias("h"), "views", "quality").collect()
    found.sort(key=lambda r: (r.h, bytes(r.views)))
    x = np.frombuffer(b"".join(bytes(r.views) for r in found), "<f4").reshape(-1, N_TEXT + N_META)
    return co_train(_split(x), np.array([int(r.quality != 0) for r in found]), pool_sums(pool))


def train_on(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, str, str] = META) -> Model:
    return train(written(features(df, id_col, text_col, meta), "views"), labels, id_col)


def scored(numbers: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (the probability of good quality), held_out, predicted (1: keep) from rows of id and views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.probability(*_split(_numbers(batch))), pa.float64())], names=["id", "score"])

    out = numbers.select("id", "views").mapInArrow(run, f"id {dict(numbers.dtypes)['id']}, score double").withColumnRenamed("id", id_col)
    return out.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, str, str] = META, threshold: float = THRESHOLD) -> DataFrame:
    return scored(features(df, id_col, text_col, meta), model, id_col, threshold)


def keep(df: DataFrame, model: Model, text_col: str = "text", meta: tuple[str, str, str] = META, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, unchanged, that score at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            yield batch.filter(pa.array(model.probability(*_split(_of(batch, text_col, meta))) >= threshold))

    return df.mapInArrow(run, df.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = written(features(table(spark, sf_dir, "documents")), "views")
    return scored(numbers, train(numbers, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")

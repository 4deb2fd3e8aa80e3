"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

The statistics are counts and ratios of a whole text, transformed to be roughly normal. Each class gets a mean and a
covariance, shrunk towards the pooled covariance, with a small ridge; Cholesky factors are cached, and a score is the
logistic of the difference of the classes' log densities, Mahalanobis distance and determinant, plus log priors.
Training sums (count, mean, products) are added up on the executors over all labelled rows, as whole numbers: they
are the same in whatever order rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import batch, free_names, id_text, ready, slices, staged, with_docs

NAMES = ("log_words", "log_chars", "word_length", "word_spread", "upper", "digit", "mark", "odd_mark", "bang", "pipe", "space", "type_ratio", "top_share", "repeat_pair", "line_words", "line_repeat", "title", "entropy", "stop_gap", "long_word")
SHRINK, RIDGE = 0.02, 1e-3
#: Statistics are learnt from in whole parts of this size.
PART = 2.0**-16

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 ordinary mark, 5 odd mark, 6 !, 7 |, 8 space
for _cs, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (".,;:'\"?()-", 4), ("#$%&*+/<=>@[\\]^_`{}~", 5), ("!", 6), ("|", 7), (" \n\t\r\x0b\x0c", 8)):
    _CLASS[list(_cs.encode())] = _k


def statistics(text: str) -> list[float]:
    """The statistics of one text, each over all of it; those of an empty text are all 0."""
    raw = text.encode()
    if not (words := raw.split()):
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    k = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / size
    lens = np.fromiter(map(len, words), np.float64, n)
    index: dict[bytes, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    count = np.bincount(code)
    share = count / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = float(np.mean(code[1:] == code[:-1])) if n > 1 else 0.0
    upper = k[2] / max(k[1] + k[2], 1e-9)
    return [
        np.log1p(n),
        np.log1p(size),
        np.log(lens.mean()),
        np.log1p(lens.std()),
        np.sqrt(upper),
        np.sqrt(k[3]),
        np.sqrt(k[4]),
        np.sqrt(k[5]),
        np.sqrt(k[6]),
        np.sqrt(k[7]),
        k[8],
        np.log(len(count) / n) + 0.25 * np.log(n),
        np.log(share.max()),
        np.sqrt(same),
        np.log1p(n / max(1, len(lines))),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.sqrt(sum(65 <= w[0] <= 90 for w in words) / n),
        -float((share * np.log(share)).sum()) / np.log(n + 1),
        np.sqrt(float((lens <= 3).mean())),
        np.sqrt(float((lens > 20).mean())),
    ]


def cholesky(s: np.ndarray) -> np.ndarray:
    """The lower factor, by plain array operations: threaded LAPACK calls may never return in a forked driver."""
    out = np.zeros_like(s)
    for j in range(len(s)):
        row = out[j, :j]
        out[j, j] = np.sqrt(s[j, j] - (row * row).sum())
        out[j + 1 :, j] = (s[j + 1 :, j] - (out[j + 1 :, :j] * row).sum(1)) / out[j, j]
    return out


def inverse_of(lower: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangle, by forward substitution."""
    out = np.zeros_like(lower)
    for i in range(len(lower)):
        out[i] = ((np.arange(len(lower)) == i) - (lower[i, :i, None] * out[:i]).sum(0)) / lower[i, i]
    return out


@dataclass
class Discriminant:
    """Means, Cholesky factors of the inverse covariances, log determinants and log priors of classes 0 and 1."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    @staticmethod
    def fit(n: np.ndarray, total: np.ndarray, product: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
        """From each class's count, sums and sums of products. A class without rows takes the other's mean."""
        d = total.shape[1]
        if not n.sum():
            n, product = np.ones(2), np.stack([np.eye(d)] * 2)
        whole = n.sum()
        centre = total.sum(0) / whole
        scale = np.sqrt(np.maximum(np.diagonal(product.sum(0)) / whole - centre**2, 0))
        scale = np.where(scale > 1e-9, scale, 1)
        mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
        for c in (0, 1):
            if n[c]:
                m = total[c] / n[c]
                mean[c] = (m - centre) / scale
                cov[c] = (product[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale)
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / whole
        factor, logdet = np.zeros((2, d, d)), np.zeros(2)
        for c in (0, 1):
            # Fewer rows, more of the pooled covariance.
            a = min(1.0, shrink + d / max(n[c], 1))
            s = (1 - a) * cov[c] + a * pooled
            chol = cholesky(s + ridge * np.eye(d))
            factor[c], logdet[c] = inverse_of(chol), 2 * np.log(np.diag(chol)).sum()
        return Discriminant(mean, factor, logdet, np.log((n + 1) / (whole + 2)), centre, scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log = np.stack([self.prior[c] - 0.5 * (self.logdet[c] + (((z - self.mean[c]) @ self.factor[c].T) ** 2).sum(1)) for c in (0, 1)])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each text, null as empty."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
        for b in slices(batches):
            yield batch(schema, b.column(0), [statistics(t) for t in b.column(1).to_pylist()])

    return id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id bigint, x array<double>")


def held_out(doc_id):
    """Rows that are never learnt from: crc32 of the id, as text, mod 3 is 1. A null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """Learns from all labelled rows that aren't held out. Ids with null or both labels are left out; others count once."""
    one = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    one = one.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = [0] * (2 + 2 * d + 2 * d * d)
        for b in batches:
            x = np.rint(b.column(0).values.to_numpy(zero_copy_only=False).reshape(-1, d) / PART).astype(np.int64)
            y = b.column(1).to_numpy(zero_copy_only=False)
            # A statistic is below 2 ** 8, so that the sum of a thousand products fits.
            for i in range(0, len(x), 1000):
                own = [x[i : i + 1000][y[i : i + 1000] == c] for c in (0, 1)]
                parts = [[len(o) for o in own], *(o.sum(0) for o in own), *((o.T @ o).ravel() for o in own)]
                flat = [a + int(v) for a, v in zip(flat, np.concatenate(parts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(map(Decimal, flat), pa.decimal128(38, 0))], names=["k", "v"])

    # 2 + 2 d + 2 d d numbers come to the driver.
    rows = stats.join(one, "doc_id").select("x", "y").mapInArrow(sums, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in rows:
        flat[r["k"]] = float(r["v"]) * (1 if r["k"] < 2 else PART if r["k"] < 2 + 2 * d else PART * PART)
    return Discriminant.fit(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of stats."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = stats.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Statistics of all documents are written once; the model is learnt from the labelled ones and scores all.

    Null texts are scored as empty ones, repeated rows each on its own; without labels every score is 0.5; an empty
    table gives no rows. labels, lang, source and doc_id are not inputs of a score.
    """
    stats = staged(document_statistics(docs, **columns), "statistics")
    return score(stats, train(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the documents that score below threshold; repeated ids stay if any of their rows does."""
    name = free_names(docs, "score")["score"]
    scores = classify(docs, labels).groupBy("doc_id").agg(F.max("score").alias(name))
    return with_docs(docs, scores).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier on shape features (symbols, capitals, separators,
repetition, word length) gives each document's evidence.  Grouped sums give host
and path posteriors: the host's mean is shrunk toward the global one and the
path's toward its host's, each with a strength that the method of moments takes
from how much groups differ.  A document's score adds its path's shift to its
own evidence.

The classifier is fitted on at most TRAIN_ROWS labelled rows (eight numbers
each) outside the held-out fold; all sums run over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

TRAIN_ROWS = 20_000
FEATURES = 8
#: Bounds of the prior strengths, in documents.
WEAKEST, STRONGEST = 2.0, 1e4

_KINDS = {
    "letter": C.byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128),
    "upper": C.byte_table(lambda b: 65 <= b <= 90),
    "digit": C.byte_table(lambda b: 48 <= b <= 57),
    "sign": C.byte_table(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-"),
    "pipe": C.byte_table(lambda b: b in b"|\t"),
}


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Eight shape features of each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, doc = C.split_words(data, offsets, C.SPACE_WORDS)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    share = {}
    for k, table in _KINDS.items():
        sums = np.concatenate(([0], np.cumsum(table[data])))
        share[k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
    h = C.hash_spans(data, starts, ends)
    pairs = np.unique(np.stack([doc.astype(C.U64), h], axis=1), axis=0)[:, 0].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs, minlength=n) / words
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / words if len(h) > 1 else np.zeros(n)
    length = np.bincount(doc, ends - starts, n) / words
    return np.stack([share["letter"], share["upper"], share["digit"], share["sign"], share["pipe"], distinct, again, np.log1p(length)], axis=1)


class Logistic:
    """Ridge logistic regression on standardised features with their squares, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ self.w)
            self.w += np.clip(move, -3, 3)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -12, 12)


def _measured(docs: DataFrame) -> DataFrame:
    return C.append_columns(docs, lambda: lambda part, data, offsets: [pa.array(list(features_of(data, offsets)), pa.list_(pa.float64()))], "array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, fold: int = 4, held: int = 1) -> Logistic | None:
    """A classifier from labelled rows outside the held-out fold; none unless both classes are seen."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = docs.select("doc_id", "text")
    chosen = C.bounded_sample(docs, F.col("text").isNotNull() & (C.crc_mod("doc_id", fold) != held), rows, 5, marks)
    found = _measured(docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality"))
    # one row a doc_id, however often it is repeated
    got = found.groupBy(F.col("c0").alias("doc_id")).agg(F.first("c2").alias("y"), F.min("x0").alias("x")).collect()
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in got], float)
    if not len(got) or y.min() == y.max():
        return None
    return Logistic(np.array([r.x for r in got]), y)


def _strength(groups: DataFrame, n: str, s: str, mean: Column, parents: int) -> float:
    """Prior strength of groups around their parents' means, by the method of moments.

    ``n`` documents of a group sum to ``s`` and their squares to q; ``parents``
    means were taken from the same documents.  With between-group variance v, a
    beta prior of strength a has v = mean * (1 - mean) / (a + 1).
    """
    own = F.col(s) / F.col(n)
    k, docs, between, within, whole = groups.agg(F.count("*"), F.sum(n), F.sum(F.col(n) * (own - mean) ** 2), F.sum(F.col("q") - F.col(n) * own**2), F.sum(F.col(n) * mean * (1 - mean))).first()
    if not docs or k <= parents:
        return STRONGEST
    noise = within / max(docs - k, 1)  # within-group variance
    spread = max(0.0, (between - (k - parents) * noise) / docs)
    return float(np.clip(whole / docs / spread - 1 if spread > 0 else STRONGEST, WEAKEST, STRONGEST))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", limit: float = 0.5) -> DataFrame:
    """doc_id, host, path, held_out, evidence, host_posterior, path_posterior, score, keep of every row.

    ``host`` and ``path`` name the site columns; null stands for one unknown
    site.  Null and empty texts have the features of an empty text, very long
    ones are measured whole.  Without labels of both classes evidence is 0.5
    throughout.  Repeated rows count each in their site's sums; a null doc_id
    keeps its row and counts as an empty one for its fold; other columns are
    ignored, whatever their names; an empty table gives none.
    """
    scratch = C.Scratch(docs.sparkSession)
    model = train(docs, labels)
    rows = docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda part, data, offsets: [pa.array(1 / (1 + np.exp(-m.logits(features_of(data, offsets)))) if m else np.full(len(offsets) - 1, 0.5), pa.float64())]

    found = C.append_columns(rows, make, "double").select(F.col("c0").cast("long").alias("doc_id"), F.col("c2").alias("host"), F.col("c3").alias("path"), F.col("x0").alias("evidence"))
    found = scratch.save(found)
    # sites: sums over all documents, pre-aggregated on each task
    paths = scratch.save(found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts = scratch.save(hosts)
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = float(np.clip((s or 0.5) / (n or 1), 1e-4, 1 - 1e-4))
    sites = scratch.save(paths.join(hosts.select("host", "hn", "hs"), "host"))
    a = _strength(hosts, "n", "s", F.lit(mean), 1)
    b = _strength(sites, "n", "s", F.col("hs") / F.col("hn"), hosts.count())
    sites = sites.withColumn("host_posterior", (F.col("hs") + a * mean) / (F.col("hn") + a))
    sites = sites.withColumn("path_posterior", (F.col("s") + b * F.col("host_posterior")) / (F.col("n") + b)).select("host", "path", "host_posterior", "path_posterior")
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    total = logit(F.col("evidence")) + logit(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))
    out = found.join(sites, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-total)))
    return out.select("doc_id", "host", "path", (C.crc_mod("doc_id", 4) == 1).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= limit).alias("keep"))

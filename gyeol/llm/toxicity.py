"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of four to eight letters, hashed into 2^24 buckets; that a bucket occurs once, twice or four
times at least are three binary features of a text. The machine's inputs are the features that tell the two labels apart most (by the z score of their document
frequencies), and those that do so in pairs only, such as an insult and the mention of a group that are neutral by themselves: pairs of frequent terms are tried, and both
terms of a pair that tells far more than either are inputs. There are a bias, linear weights, and FACTORS factors each, so that pairs of terms count beyond their sum.
The machine is fitted on the driver, on a sample of labelled rows that is bounded by SAMPLE and the same on every run; scoring reads whole texts.

Defined cases: a null or empty text has no terms and gets the bias; a doc_id of several labels counts as toxic if one says so; null labels are
ignored; without both labels in the training rows every score is 0; repeated rows give repeated rows; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gyeol.llm.common import durable, in_batches

#: Labelled rows of each label that are used for fitting, at most; those of the smallest hash.
SAMPLE = 5_000
#: Inputs of the machine, at most, and their least z score.
INPUTS, LEAST_Z = 512, 5.0
#: Terms that are tried in pairs (the most frequent ones in at least PAIR_ROWS rows, but not in over half of them), and pairs whose terms become inputs, at most; by how much
#: the z score of such a pair must exceed those of its terms.
PAIR_TERMS, PAIR_ROWS, PAIRS, PAIR_Z = 1_024, 20, 128, 4.0
FACTORS = 4
THRESHOLD = 0.7
BUCKETS = 1 << 24
LEVELS = (1, 2, 4)
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms_of(word: str) -> set[int]:
    return {zlib.crc32(t.encode()) % BUCKETS for t in (word, *(f"{word[:k]}-" for k in range(4, 9) if len(word) >= k))}


def features_of(text: str | None) -> list[int]:
    """feature * 3 + level for each level that the bucket's count reaches."""
    n: dict[int, int] = {}
    for w, k in Counter(WORD.findall((text or "").lower())).items():
        for b in terms_of(w):
            n[b] = n.get(b, 0) + k
    return [b * 3 + i for b, k in n.items() for i, least in enumerate(LEVELS) if k >= least]


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, text. Ids are chosen first, from labels alone; they are few by per_label and so can be broadcast."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda c: ids.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    few = pick("toxic = 1").unionByName(pick("toxic <> 1"))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # an id may have any number of rows


def inputs(rows: DataFrame, n1: int, n0: int) -> tuple[list[int], list[int]]:
    """The features of the highest |z|, INPUTS at most, and terms to be tried in pairs, PAIR_TERMS at most; counted where the rows are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[int, list[int]] = {}
            for toxic, text in zip(b["toxic"], b["text"], strict=True):
                for k in features_of(text):
                    found.setdefault(k, [0, 0])[1 if toxic == 1 else 0] += 1
            yield pd.DataFrame({"feature": list(found), "c1": [x[1] for x in found.values()], "c0": [x[0] for x in found.values()]})

    c = in_batches(rows).mapInPandas(count, "feature long, c1 long, c0 long").groupBy("feature").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    p = (F.col("c1") + F.col("c0") + 0.5) / (n1 + n0 + 1)
    z = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    c = durable(c.where(F.col("c1") + F.col("c0") >= 3))
    best = c.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(INPUTS)
    n = F.col("c1") + F.col("c0")
    pairs = c.where((F.col("feature") % len(LEVELS) == 0) & n.between(PAIR_ROWS, (n1 + n0) / 2)).orderBy(F.desc(n), "feature").limit(PAIR_TERMS)
    return [r.feature for r in best.collect()], [r.feature for r in pairs.collect()]


def telling_pairs(x: np.ndarray, y: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Columns of x (terms present) that are in a pair whose z score is PAIR_Z above those of both its terms; of the PAIRS best pairs."""
    if x.shape[1] < 2:
        return np.zeros(0, dtype=int)
    a, b = x[y == 1], x[y == 0]
    c1, c0 = (a.T @ a).astype(np.float64), (b.T @ b).astype(np.float64)
    p = (c1 + c0 + 0.5) / (n1 + n0 + 1)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    own = np.diag(z)
    gain = np.triu(z - np.maximum(own[:, None], own[None, :]), 1)
    # terms that always stand together (a word and its own beginning) are one term
    support = np.diag(c1 + c0)
    gain[(c1 + c0) > 0.9 * np.minimum(support[:, None], support[None, :])] = 0
    gain[z < LEAST_Z] = 0
    best = np.argsort(-gain, axis=None, kind="stable")[:PAIRS]
    best = best[gain.flat[best] >= PAIR_Z]
    return np.unique(np.concatenate(np.unravel_index(best, gain.shape)))


def training_rows(rows: DataFrame, index: dict[int, int]) -> pd.DataFrame:
    """doc_id, toxic, the features of index present: at most INPUTS + PAIR_TERMS numbers a row of the sample."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "inputs": [sorted(index[k] for k in features_of(t) if k in index) for t in b["text"]]})

    return in_batches(rows).mapInPandas(terms, "doc_id long, toxic int, inputs array<int>").toPandas()


class Machine:
    """p(toxic) = sigmoid(bias + sum w_i + sum of pairs <v_i, v_j>) over the inputs present."""

    def __init__(self, index: dict[int, int], bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.index, self.bias, self.w, self.v = index, bias, w, v
        self.seen: dict[str, tuple[int, ...]] = {}
        self.buckets = {k // 3 for k in index}

    def logit(self, on: list[int]) -> float:
        if not on:
            return self.bias
        s = self.v[on]
        total = s.sum(0)
        return float(self.bias + self.w[on].sum() + 0.5 * ((total * total).sum() - (s * s).sum()))

    def score(self, text: str | None) -> float:
        get, n = self.seen.get, {}
        for w, k in Counter(WORD.findall((text or "").lower())).items():
            of = get(w)
            if of is None:
                if len(self.seen) > 100_000:  # words of one worker, not of the corpus
                    self.seen.clear()
                of = self.seen[w] = tuple(b for b in terms_of(w) if b in self.buckets)
            for b in of:
                n[b] = n.get(b, 0) + k
        on = {self.index[f] for b, k in n.items() for i, least in enumerate(LEVELS) if k >= least and (f := b * 3 + i) in self.index}
        return 1 / (1 + float(np.exp(-np.clip(self.logit(sorted(on)), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, rounds: int = 300) -> Machine | None:
    few = durable(sample(docs, labels, per_label))
    n = {bool(r.toxic == 1): r["count"] for r in few.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not (n1 and n0):
        return None
    best, tried = inputs(few, n1, n0)
    every = list(dict.fromkeys(best + tried))
    rows = training_rows(few, {b: i for i, b in enumerate(every)}).sort_values("doc_id", ignore_index=True, kind="stable")
    y = (rows["toxic"] == 1).to_numpy().astype(np.float64)
    x = np.zeros((len(y), len(every)), dtype=np.float32)
    for i, on in enumerate(rows["inputs"]):
        x[i, on] = 1
    at = {f: i for i, f in enumerate(every)}
    cols = np.array([at[f] for f in tried], dtype=int)
    best = list(dict.fromkeys(best + [tried[i] for i in telling_pairs(x[:, cols], y, n1, n0).tolist()]))
    x = np.ascontiguousarray(x[:, [at[f] for f in best]])
    rng = np.random.default_rng(8)
    th = [np.zeros(1), np.zeros(len(best)), rng.normal(0, 0.05, (len(best), FACTORS))]
    m, s = [np.zeros_like(t) for t in th], [np.zeros_like(t) for t in th]
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for r in range(1, rounds + 1):
        xv = x @ th[2]
        out = th[0] + x @ th[1] + 0.5 * ((xv * xv).sum(1) - x @ (th[2] * th[2]).sum(1))
        g = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y)
        gx = x.T @ g
        grads = [np.array([g.sum()]), gx + 1e-4 * th[1], x.T @ (g[:, None] * xv) - gx[:, None] * th[2] + 1e-3 * th[2]]
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
            th[k] = th[k] - 0.1 * (m[k] / (1 - 0.9**r)) / (np.sqrt(s[k] / (1 - 0.999**r)) + 1e-8)
    return Machine({b: i for i, b in enumerate(best)}, float(th[0][0]), th[1], th[2])


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """docs and __score, from whole texts."""
    if machine is None:
        return docs.withColumn("__score", F.lit(0.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([machine.score(t) for t in b["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, "__score"])

    return in_batches(docs).mapInArrow(rows, StructType([*docs.schema.fields, StructField("__score", DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    df = score(docs.select("doc_id", "text"), fit(docs, labels))
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are scored toxic."""
    return score(docs, fit(docs, labels)).where(F.col("__score") < THRESHOLD).select(*docs.columns)

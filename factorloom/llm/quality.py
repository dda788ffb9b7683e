"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are hashed to BUCKETS rows. Each bucket has a sparse random index vector; the vector of a
word is the sum of the index vectors of its neighbours over the whole corpus, at unit length. Tasks
sum their own table of BUCKETS x DIMS counts, which bounds what they hold and shuffle. A document
is the mean and the spread of its words' vectors. The network is fitted on the driver by numpy on
at most TRAIN_ROWS labelled ids (a bounded, documented sample, by hash order); a part of them that
the fit does not see sets the temperature that calibrates its probabilities.

Only the text is an input of a score. Rows whose crc32(doc_id as text) mod 4 is 2 are never learnt.

Defined results: a null text counts as empty, and an empty text gets the network's score of a zero
vector; labels that are null or other than 0 and 1 are not learnt; if fewer than two classes are
labelled, every score is the share of label 1 among them (0.5 without any); an id with several labels
is learnt once for each, and once if several rows bear it; repeated rows get equal scores; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

BUCKETS = 1 << 14
DIMS = 32
WINDOW = 2
ENTRIES = 2
TRAIN_ROWS = 20_000
KEEP = 0.7
CHUNK = 1 << 15


def word_ids(text: Column) -> Column:
    """Buckets of a text's words and signs in order; words in capitals are one word."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0))
    shape = lambda w: F.when((F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w), F.lit("<CAPS>")).otherwise(F.lower(w))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(shape(w)), F.lit(BUCKETS)).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def index_vectors():
    """Dimensions and signs of each bucket's ENTRIES non-zero entries; a last row without any."""
    rng = np.random.default_rng(5)
    dims = rng.integers(0, DIMS, (ENTRIES, BUCKETS + 1))
    signs = rng.choice([-1.0, 1.0], (ENTRIES, BUCKETS + 1))
    signs[:, BUCKETS] = 0
    return dims, signs


def _lists(column: pa.Array):
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths


def _sum_contexts(batches):
    dims, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS)
    for batch in batches:
        flat, lengths = _lists(batch.column("ids"))
        ids = np.full(len(flat) + WINDOW * (len(lengths) + 1), BUCKETS)
        ids[np.arange(len(flat)) + WINDOW * (1 + np.repeat(np.arange(len(lengths)), lengths))] = flat
        for at in range(0, len(ids), CHUNK):
            part = ids[max(0, at - WINDOW) : at + CHUNK]
            for gap in range(1, WINDOW + 1):
                fresh = slice(max(0, min(at, WINDOW) - gap), None)
                a, b = part[:-gap][fresh], part[gap:][fresh]
                inside = (a < BUCKETS) & (b < BUCKETS)
                for word, near in ((a[inside], b[inside]), (b[inside], a[inside])):
                    for e in range(ENTRIES):
                        total += np.bincount(word * DIMS + dims[e][near], signs[e][near], BUCKETS * DIMS)
    table = total.reshape(BUCKETS, DIMS).astype(np.int64)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "sums": pa.array(list(table[used]), pa.list_(pa.int64()))})


def _add_up(batches):
    total = {}
    for batch in batches:
        for bucket, sums in zip(batch.column("bucket").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            total[bucket] = total.get(bucket, 0) + np.array(sums)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int32()), "sums": pa.array(list(total.values()), pa.list_(pa.int64()))})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from all rows of docs; BUCKETS x DIMS whatever the corpus."""
    schema = "bucket int, sums array<long>"
    parts = docs.select(word_ids(F.col("text")).alias("ids")).mapInArrow(_sum_contexts, schema)
    table = parts.repartition("bucket").mapInArrow(_add_up, schema).toPandas()
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    for bucket, sums in zip(table["bucket"], table["sums"], strict=True):
        vectors[bucket] = np.asarray(sums, float) / max(1e-9, np.linalg.norm(np.asarray(sums, float)))
    return vectors


def pooled(flat: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each list of buckets."""
    n, out = len(lengths), np.zeros((len(lengths), 2 * DIMS))
    rows = np.repeat(np.arange(n), lengths)
    for at in range(0, len(flat), CHUNK):
        row, found = rows[at : at + CHUNK], vectors[flat[at : at + CHUNK]].astype(np.float64)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first], :DIMS] += np.add.reduceat(found, first, axis=0)
        out[row[first], DIMS:] += np.add.reduceat(found * found, first, axis=0)
    out /= np.maximum(lengths, 1)[:, None]
    out[:, DIMS:] = np.sqrt(np.maximum(0, out[:, DIMS:] - out[:, :DIMS] ** 2))
    return out


def pooling(vectors) -> object:
    """A function from bucket lists to features; vectors is a broadcast of a table of fixed size."""

    @F.pandas_udf("array<float>")
    def pool(ids: pd.Series) -> pd.Series:
        lengths = ids.map(len).to_numpy() if len(ids) else np.zeros(0, int)
        flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        return pd.Series(list(pooled(flat, lengths, vectors.value).astype(np.float32)))

    return pool


class Network:
    """tanh layer and logit, standardised inputs, temperature; fitted by Adam on given rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.share = float(y.mean()) if len(y) else 0.5
        self.trivial = len(np.unique(y)) < 2
        if self.trivial:
            return
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        held = order[: len(x) // 5] if len(x) >= 50 else order
        seen = order[len(x) // 5 :] if len(x) >= 50 else order
        z = (x - self.shift) / self.scale
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(epochs):
            mixed = rng.permutation(seen)
            for at in range(0, len(mixed), 128):
                rows, t = mixed[at : at + 128], t + 1
                h = np.tanh(z[rows] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        logits, goal = self.logits(x[held]), y[held]
        losses = {c: np.logaddexp(0, -(2 * goal - 1) * logits / c).mean() for c in np.geomspace(0.25, 8, 61)}
        self.temperature = min(losses, key=losses.get)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trivial:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def scoring(network: Network):
    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(network.score(np.array(features.tolist(), dtype=float).reshape(-1, 2 * DIMS)))

    return score


def learnt(ids: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, y, h): about the `rows` (1.2 times as many and a few at most) labelled ids of ids(doc_id) of the
    least hashes, found by a threshold on the hash, so that no more than these ever reach the driver."""
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    known = written(known.filter(~held_out(F.col("id"))).distinct().join(ids.select(F.col("doc_id").alias("id")), "id", "left_semi"), "known")
    n = known.count()
    hashed = known.withColumn("h", F.xxhash64("id", F.lit(11)))
    share = (1.2 * rows + 100) / max(n, 1)
    return hashed if share >= 1 else hashed.filter(F.col("h") < int(-(2**63) + share * 2**64))


def fit(features: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """The network of at most `rows` labelled ids of features(doc_id, features), by hash order; rows that
    share a doc_id are learnt once, by the least of their features."""
    train = features.join(known, F.col("doc_id") == F.col("id")).groupBy("h", "id", "y").agg(F.min("features").alias("features"))
    train = train.toPandas().sort_values(["h", "id", "y"]).head(rows)
    return Network(np.array(train["features"].tolist(), dtype=float).reshape(-1, 2 * DIMS), train["y"].to_numpy(float))


@tidy
def score_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    features = written(docs.select("doc_id", pooling(vectors)(word_ids(F.col("text"))).alias("features")), "features")
    network = fit(features, learnt(features, labels, rows), rows)
    return features.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), scoring(network)("features").alias("score")
    ).withColumn("predicted", (F.col("score") >= keep).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    pool, names = pooling(vectors), docs.columns
    known = learnt(docs, labels, rows)
    mine = docs.select("doc_id", "text").join(known.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    network = fit(mine.select("doc_id", pool(word_ids(F.col("text"))).alias("features")), known, rows)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    kept = docs.select(row, scoring(network)(pool(word_ids(F.col("text")))).alias("score")).filter(F.col("score") >= keep)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

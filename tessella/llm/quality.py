"""Quality scores by a factorisation machine over hashed words, structure statistics and text length."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, add_columns, ascii_words, hash_sample, held_out

BUCKETS = 1 << 15
FACTORS = 8
#: Statistics are cut at quantiles into so many bins, each a feature of its own.
BINS = 10
#: Labelled documents to learn from, at most.
SAMPLE = 6000
#: Passes over the sample, and steps of the fit at least; small samples are passed over more often.
EPOCHS, LEAST_STEPS = 6, 500

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOL = b"#$%&*@^~<>=\\"


def _share(raw: bytes, chars: bytes) -> float:
    return (len(raw) - len(raw.translate(None, chars))) / max(1, len(raw))


def statistics(text: str | None, words: list[bytes]) -> list[float]:
    """Numbers that describe a text's form; all 0 for an empty one. The last is its length, known as metadata."""
    if not words:
        return [0.0] * N_STATISTICS
    raw = text.encode("utf-8", "replace")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, counts = len(words), Counter(words)
    letters = _share(raw, _UPPER + _LOWER)
    return [
        np.log1p(n), len(raw) / n, _share(raw, _UPPER) / max(letters, 1e-3), _share(raw, _DIGIT), _share(raw, _PUNCT), _share(raw, _SYMBOL),
        raw.count(b"|") / n, raw.count(b"!") / n, raw.count(b".") / n, raw.count(b",") / n, len(counts) / n, counts.most_common(1)[0][1] / n,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, words))), np.log1p(len(text)),
    ]


N_STATISTICS = 16


@dataclass
class Machine:
    """w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)."""

    bias: float
    weights: np.ndarray  # (features,)
    factors: np.ndarray  # (features, FACTORS)
    edges: np.ndarray  # (N_STATISTICS, BINS - 1)

    def rows(self, buckets: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, their values and where each row starts; statistics come after the words."""
        ids, values, starts, at = [], [], [], 0
        base = BUCKETS + np.arange(N_STATISTICS) * BINS
        for words, s in zip(buckets, stats, strict=True):
            bins = base + (s[:, None] > self.edges).sum(axis=1)
            ids += [words, bins]
            values += [np.full(len(words), 1 / np.sqrt(max(1, len(words)))), np.full(N_STATISTICS, 1 / np.sqrt(N_STATISTICS))]
            starts.append(at)
            at += len(words) + N_STATISTICS
        return np.concatenate(ids), np.concatenate(values), np.array(starts)

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx**2, starts)
        return self.bias + np.add.reduceat(self.weights[ids] * values, starts) + 0.5 * (sums**2 - squares).sum(axis=1)

    def scores(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(buckets, stats)), -30, 30)))


def fit(buckets: list[np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-4, batch: int = 64) -> Machine:
    """Adagrad on the logistic loss; the order of rows is fixed, so equal samples give equal models."""
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    rng, size = np.random.default_rng(7), BUCKETS + N_STATISTICS * BINS
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    m = Machine(float(np.log(mean / (1 - mean))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), edges)
    g_w, g_v, g_b = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            ids, values, starts = m.rows([buckets[k] for k in part], stats[part])
            lengths = np.diff(np.append(starts, len(ids)))
            vx = m.factors[ids] * values[:, None]
            sums = np.add.reduceat(vx, starts)
            margin = m.bias + np.add.reduceat(m.weights[ids] * values, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
            e = np.repeat(err, lengths)
            used, where = np.unique(ids, return_inverse=True)
            d_w = np.bincount(where, e * values, len(used)) + l2 * m.weights[used]
            row_v = (e * values)[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
            d_v = np.stack([np.bincount(where, row_v[:, f], len(used)) for f in range(FACTORS)], axis=1) + l2 * m.factors[used]
            g_w[used] += d_w**2
            g_v[used] += d_v**2
            g_b += err.sum() ** 2
            m.weights[used] -= rate * d_w / np.sqrt(g_w[used])
            m.factors[used] -= rate * d_v / np.sqrt(g_v[used])
            m.bias -= rate * err.sum() / np.sqrt(g_b)
    return m


def _inputs(ids: WordIds, text: str | None) -> tuple[np.ndarray, list[float]]:
    words = ascii_words(text)
    return np.unique(ids.array(words) & np.uint64(BUCKETS - 1)).astype(np.int64), statistics(text, words)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Machine | None:
    """A machine from at most SAMPLE labelled documents; None if only one label is there.

    ``labels`` holds the rows to learn from. Ids with several labels count with their mean; null ids and
    null labels are left out. Of an id with several texts the least one is read, in binary order; texts are read whole.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).dropna().groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = F.broadcast(hash_sample(known, F.col("id"), SAMPLE))  # SAMPLE rows at most

    def run(batches):
        ids = WordIds()
        for b in batches:
            rows = [_inputs(ids, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["y", "words", "stats"])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    picked = texts.join(known, "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text").mapInArrow(run, "y int, words array<int>, stats array<float>")
    table = picked.toArrow()
    y = table.column("y").to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    words = [np.array(w, dtype=np.int64) for w in table.column("words").to_pylist()]
    stats = np.array(table.column("stats").to_pylist(), dtype=float)
    # Rows come in any order; by content, the fit is the same on every run.
    order = sorted(range(len(y)), key=lambda k: (len(words[k]), stats[k].tolist(), y[k], words[k][:8].tolist()))
    return fit([words[k] for k in order], stats[order], y[order])


def score_quality(docs: DataFrame, model: Machine | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1. Empty and null texts get the score of no words; without a model all get 0.5.

    Every row is scored alone and whole, so repeated rows have equal scores; a very long text costs memory for itself. A
    column named score is replaced, others pass through; an empty table gives no rows.
    """

    def make():
        ids = WordIds()

        def each(texts):
            if model is None or not texts:
                return [[0.5] * len(texts)]
            rows = [_inputs(ids, t) for t in texts]
            return [model.scores([r[0] for r in rows], np.array([r[1] for r in rows], dtype=float))]

        return each

    return add_columns(docs, [text], make, {"score": ("double", pa.float64())})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"), 3, 1)))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

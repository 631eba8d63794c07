"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, add_columns, ascii_words, cut, pieces, small_batches, stage

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a category: its own share to this power, scaled to 1. It moves weight to rare ones.
TEMPER = 0.7
#: Tokens of the mix, as a share of all tokens; documents of a cell with a large weight are taken several times.
FRACTION = 0.5
#: The fit ends when every marginal is this near to its target, or when a round takes the deviation down by less than STALLED of
#: it, or after ROUNDS; what still deviates is told in the result.
TOLERANCE, STALLED = 1e-6, 1e-3
ROUNDS = 100
#: Cells (combinations of categories) up to this number are fitted on the driver; more are fitted by Spark, by the same rules.
DRIVER_CELLS = 200_000
#: Hashed terms whose co-occurrence makes topics, and topics, a power of two.
TERMS, TOPICS = 256, 8


# Topics


@dataclass(frozen=True)
class Topics:
    """Clusters of hashed terms that occur together; a text's topic is the cluster of most of its weighted terms."""

    cluster: np.ndarray  # (TERMS,) of ints
    weight: np.ndarray  # (TERMS,)

    def of(self, counts: np.ndarray) -> str:
        if not counts.any():
            return "empty"
        # The logarithm keeps one term repeated many times from deciding alone.
        return f"topic{int(np.bincount(self.cluster, np.log1p(counts) * self.weight, TOPICS).argmax())}"


def _term_counts(ids: WordIds, words: list[bytes]) -> np.ndarray:
    # The hash's upper bits: words of any table size are dealt evenly.
    return np.bincount((ids.array(words) >> np.uint64(56)).astype(np.int64), minlength=TERMS)


def learn_topics(docs: DataFrame, text: str = "text") -> Topics:
    """Topics from all of ``docs``: each task sums up how often terms meet in a text, TERMS x TERMS numbers.

    The terms' rows of pointwise mutual information are parted on the driver along their main directions, each at its
    median. An empty table gives any parting.
    """

    def meet(batches):
        ids, total, seen = WordIds(), np.zeros((TERMS, TERMS), dtype=np.int64), 0
        for batch in pieces(batches):
            present = np.array([_term_counts(ids, ascii_words(t)) > 0 for t in batch.column(0).to_pylist()], dtype=np.float32).reshape(-1, TERMS)
            total += (present.T @ present).astype(np.int64)  # at most a batch's rows: exact in float32
            seen += len(present)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([seen]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "n", "met"])

    def add(batches):
        total, seen = np.zeros((TERMS, TERMS), dtype=np.int64), 0
        for batch in batches:
            for n, met in zip(batch.column("n").to_pylist(), batch.column("met").to_pylist(), strict=True):
                total += np.frombuffer(zlib.decompress(met), dtype=np.int64).reshape(TERMS, TERMS)
                seen += n
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([seen]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "n", "met"])

    schema = "part int, n bigint, met binary"
    small_batches(docs.sparkSession)
    sums = docs.select(F.col(text)).mapInArrow(meet, schema).repartition(16).mapInArrow(add, schema).collect()  # 16 rows
    met = sum((np.frombuffer(zlib.decompress(r["met"]), dtype=np.int64).reshape(TERMS, TERMS) for r in sums), np.zeros((TERMS, TERMS), dtype=np.int64))
    n = max(1, sum(r["n"] for r in sums))
    own = np.maximum(met.diagonal(), 1) / n
    mutual = np.log((met + 0.5) / n / np.outer(own, own))
    np.fill_diagonal(mutual, 0.0)
    # Terms on the two sides of each of the directions in which their companies differ most.
    directions = np.linalg.svd(mutual - mutual.mean(axis=0))[0][:, : TOPICS.bit_length() - 1]
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    cluster = ((directions > np.median(directions, axis=0)) << np.arange(directions.shape[1])).sum(axis=1)
    return Topics(cluster, np.maximum(-np.log(np.minimum(own, 1.0)), 1e-3))


def with_topic(docs: DataFrame, topics: Topics, text: str = "text", topic: str = "topic", tokens: str = "mix_tokens") -> DataFrame:
    """``docs`` with the topic of ``text`` and its number of words between ASCII white space; null texts are empty."""

    def make():
        ids = WordIds()

        def each(texts):
            words = [ascii_words(t) for t in texts]
            return [[topics.of(_term_counts(ids, w)) for w in words], list(map(len, words))]

        return each

    return add_columns(docs, [text], make, {topic: ("string", pa.string()), tokens: ("bigint", pa.int64())})


# Fitting


def _shares(table: dict, power: float) -> dict:
    raised = {k: v**power if v > 0 else 0.0 for k, v in table.items()}
    total = sum(raised.values())
    return {k: v / total if total else 0.0 for k, v in raised.items()}


def fit_cells(cells: DataFrame, dims: tuple[str, ...], targets: dict[str, dict[str, float]] | None, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, float]:
    """``cells`` (dims, tokens) with ``weight``, fitted so that every marginal of weighted tokens meets its target; and the deviation.

    Targets are given as shares by dimension and category, for categories that have tokens; a dimension
    without any of these gets tempered shares. The deviation is the largest one of a marginal from its
    target, relative to it, as the fit ends: targets that no weights can meet together leave one.
    """
    if cells.limit(driver_cells + 1).count() > driver_cells:
        return _fit_spread(cells, dims, targets)
    rows = cells.collect()  # driver_cells at most
    tokens = np.array([r["tokens"] for r in rows], dtype=float)
    weight, worst = np.ones(len(rows)), 0.0
    codes, goals = [], []
    for d in dims if rows else ():
        names, code = np.unique([r[d] for r in rows], return_inverse=True)
        actual = dict(zip(names.tolist(), np.bincount(code, tokens, len(names)).tolist(), strict=True))
        goal = {k: v for k, v in (targets or {}).get(d, {}).items() if actual.get(k, 0) > 0 and v > 0}
        share = _shares(goal, 1.0) if goal else _shares(actual, TEMPER)
        codes.append(code)
        goals.append(np.array([share.get(k, 0.0) for k in names.tolist()]) * tokens.sum())
    for _ in range(ROUNDS if rows else 0):
        before = worst
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, tokens * weight, len(goal))
            weight *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        worst = max(_deviation(np.bincount(code, tokens * weight, len(goal)), goal) for code, goal in zip(codes, goals, strict=True))
        if _ended(worst, before):
            break
    data = [(*[r[d] for d in dims], int(r["tokens"]), float(w)) for r, w in zip(rows, weight, strict=True)]
    return cells.sparkSession.createDataFrame(data, ", ".join(f"`{d}` string" for d in dims) + ", tokens bigint, weight double"), worst


def _ended(worst: float, before: float) -> bool:
    return worst < TOLERANCE or abs(before - worst) < STALLED * before


def _deviation(now: np.ndarray, goal: np.ndarray) -> float:
    return float(np.max(np.abs(now[goal > 0] / goal[goal > 0] - 1), initial=0.0))


def _fit_spread(cells: DataFrame, dims: tuple[str, ...], targets: dict[str, dict[str, float]] | None) -> tuple[DataFrame, float]:
    """The same fit where cells are too many for the driver: a cell's weight is the product of a factor a dimension.

    One aggregate over the cells gives a dimension's marginal, from which its factors follow.
    """
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    state = {}
    for d in dims:
        actual = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("now"))
        given = [(k, float(v)) for k, v in (targets or {}).get(d, {}).items() if v > 0]
        goal = actual.join(spark.createDataFrame(given, f"`{d}` string, share double"), d, "left").select(d, F.when(F.col("now") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("goal"))
        if not (given and goal.agg(F.max("goal")).first()[0]):
            goal = actual.select(d, F.when(F.col("now") > 0, F.pow("now", F.lit(TEMPER))).otherwise(0.0).alias("goal"))
        whole = goal.agg(F.sum("goal")).first()[0] or 1.0
        state[d] = cut(goal.select(d, (F.col("goal") / F.lit(whole) * F.lit(total)).alias(f"goal_{d}"), F.lit(1.0).alias(f"factor_{d}")))

    weigh = lambda: reduce(lambda rows, d: rows.join(state[d].select(d, f"factor_{d}"), d), dims, cells).withColumn("weight", reduce(Column.__mul__, [F.col(f"factor_{d}") for d in dims]))
    worst = 0.0
    for _ in range(ROUNDS):
        before, worst = worst, 0.0
        for d in dims:
            now = weigh().groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            ratio = F.when(F.col("now") > 0, F.col(f"goal_{d}") / F.col("now")).otherwise(0.0)
            state[d] = cut(state[d].join(now, d).select(d, f"goal_{d}", (F.col(f"factor_{d}") * ratio).alias(f"factor_{d}"), ratio.alias("ratio")))
            # How far a marginal was off when its turn came bounds how far the round has moved it.
            off = state[d].filter(f"goal_{d} > 0").agg(F.max(F.abs(1 / F.col("ratio") - 1))).first()[0]
            worst = max(worst, off if off is not None else 0.0)
        if _ended(worst, before):
            break
    return weigh().select(*dims, "tokens", "weight"), worst


def mix(
    docs: DataFrame,
    dims: dict[str, Column],
    tokens: Column,
    key: list[Column],
    targets: dict[str, dict[str, float]] | None = None,
    fraction: float = FRACTION,
    seed: int = 0,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """``docs`` with mix_tokens, weight, probability, copies, sampled and deviation.

    Weights are raked, a weight a cell, until the weighted tokens of every category of every dimension
    are its target share; ``deviation`` tells by how much that fails (see ``fit_cells``). A row is expected
    ``weight * fraction`` times in the mix, so the mix has ``fraction`` of all tokens whatever the largest
    weight is. ``copies`` is that number's whole part, and one more with a chance of the rest: if the hash of ``key`` and
    ``seed``, as a number from 0 to 1, is below it, so equal keys have an equal fate. ``probability`` is that of one copy or more,
    ``sampled`` whether there is one.

    Null categories are a category of their own. Rows without tokens have their cell's weight. Repeated rows count
    each. Columns of the six names are replaced, those that begin with ``__mix_`` are lost; empty tables give no rows.
    """
    made = ["mix_tokens", "weight", "probability", "copies", "sampled", "deviation"]
    columns = [c for c in docs.columns if c not in made and not c.startswith("__mix_")]
    inner = {d: f"__mix_{k}" for k, d in enumerate(dims)}
    rows = docs.select(
        *[F.col(c) for c in columns], *[F.coalesce(c.cast("string"), F.lit("\0")).alias(inner[d]) for d, c in dims.items()],
        tokens.alias("__mix_tokens"), F.xxhash64(*key, F.lit(seed)).alias("__mix_hash"),
    )
    names = tuple(inner.values())
    cells = cut(rows.groupBy(*names).agg(F.sum("__mix_tokens").alias("tokens")))
    fitted, deviation = fit_cells(cells, names, {inner[d]: v for d, v in (targets or {}).items() if d in inner}, driver_cells)
    fitted = fitted.select(*names, F.col("weight").alias("__mix_weight"))
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        fitted = F.broadcast(fitted)
    joined = rows.join(fitted, list(names))
    expected = F.col("__mix_weight") * F.lit(fraction)
    uniform = F.pmod(F.col("__mix_hash"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    copies = (F.floor(expected) + (uniform < expected - F.floor(expected)).cast("long")).cast("long")
    return joined.select(
        *columns, F.col("__mix_tokens").alias("mix_tokens"), F.col("__mix_weight").alias("weight"), F.least(F.lit(1.0), expected).alias("probability"),
        copies.alias("copies"), (copies > 0).alias("sampled"), F.lit(deviation).alias("deviation"),
    )


def mix_documents(docs: DataFrame, kept: list[str] | None = None, **options) -> DataFrame:
    """``mix`` over the table ``documents``, by source, language and learned topic, with the columns ``kept`` (all) and ``topic``.

    Texts are read once for the topics and once to find each row's; what is kept is then staged. A column
    ``topic`` is replaced.
    """
    kept = [c for c in (kept or docs.columns) if c != "topic"]
    rows = docs.select(*kept, F.col("doc_id").alias("__row_id"), F.col("source").alias("__row_source"), F.col("lang").alias("__row_lang"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__row_text"), F.col("text").alias("__row_body"))
    found = with_topic(rows, learn_topics(docs), "__row_body", "topic", "__row_tokens").drop("__row_body")
    found = stage(found)
    dims = {"source": F.col("__row_source"), "lang": F.col("__row_lang"), "topic": F.col("topic")}
    return mix(found, dims, F.col("__row_tokens"), [F.col("__row_id"), F.col("__row_text")], **options).drop("__row_id", "__row_source", "__row_lang", "__row_text", "__row_tokens")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_documents(docs, kept=["doc_id", "source", "lang"])
    return mixed.select("doc_id", "source", "lang", "topic", F.col("mix_tokens").alias("n_tokens"), "weight", "probability", "copies", "sampled", "deviation")

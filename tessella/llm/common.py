"""What the text operators share: cutting lineage, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where the session has none and runs on one machine.

    What is staged there lies in one folder an application and stays, as results may be read later; it can be
    removed when the application has ended.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut``, but compressed and read by column."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{df.sparkSession.sparkContext.applicationId}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows an Arrow batch. Whole texts are wide: thousands of them in a batch would fill a task's memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps the session from handing more than BATCH_ROWS rows at once to Python: the setting is lowered, and stays so.

    Results are made lazily, after the operator has returned, so it can't be put back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def pieces(batches, rows: int = BATCH_ROWS):
    """Arrow batches cut into smaller ones, so that their Python objects stay few; at the end, freed memory is given back."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def ascii_words(text: str | None) -> list[bytes]:
    """Words between the ASCII white space characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class WordIds(dict):
    """word (bytes) -> 64-bit hash; forgets everything at ``most`` entries, so memory stays bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter sequence is one shingle; none if empty."""
    if not len(ids):
        return ids
    n = min(n, len(ids))
    last = len(ids) - n + 1
    value = mix(ids[:last])
    for k in range(1, n):
        value = mix(value + ids[k : last + k] * np.uint64(3))
    return np.unique(value)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part`` on division by ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def add_columns(df: DataFrame, inputs: list[str], make, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with the columns of ``fields`` (name -> Spark type, Arrow type) that ``make`` computes a batch at a time.

    ``make`` is called once a task and returns a function from lists of the ``inputs`` to a list of
    columns. Columns of ``df`` that have a name of ``fields`` are replaced.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in fields]
    missing = [c for c in inputs if c not in kept]
    source = df.select(*kept, *[F.col(c).alias(f"__{c}") for c in missing])
    names = [f"__{c}" if c in missing else c for c in inputs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + [f"`{n}` {t[0]}" for n, t in fields.items()])
    kinds = [t[1] for t in fields.values()]
    out_names = [*kept, *fields]

    def run(batches):
        each = make()
        for batch in pieces(batches):
            at = {name: k for k, name in enumerate(batch.schema.names)}
            made = each(*[batch.column(at[n]).to_pylist() for n in names])
            arrays = [batch.column(at[c]) for c in kept] + [m if isinstance(m, pa.Array) else pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    return source.mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the ``n`` distinct keys of least hash; the same rows on every run."""
    hashed = df.withColumn("__h", F.xxhash64(key))
    last = hashed.select("__h").distinct().orderBy("__h").limit(n).agg(F.max("__h")).first()[0]
    return hashed.filter(F.col("__h") <= F.lit(last)).drop("__h")

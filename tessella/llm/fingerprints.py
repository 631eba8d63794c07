"""I-Match fingerprints: terms within a band of document frequencies, hashed over randomised lexicons."""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, ascii_words, mix, pieces, small_batches, stage

#: Terms in at least and at most these shares of all documents make the band. It has at most
#: (mean number of distinct terms a document) / LEAST_SHARE terms, whatever the number of documents.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.05
#: Randomised lexicons within the band, and over all terms; at level j each holds one term in 2^j, and those of j + 1.
LEXICONS, WHOLE_LEXICONS = 40, 20
#: Terms that a document should have in a lexicon, about.
TERMS = 0.7
#: Distinct terms that a task holds before it passes their counts on.
COUNTED_AT_ONCE = 2_000_000

#: An odd factor a lexicon: a term is in it at level j if the upper j bits of their product are 0.
_FACTORS = mix(np.arange(1, LEXICONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Every value of a View, mixed; the lexicons' numbers and the one after.
_MIXED = mix(np.arange(1 << 16, dtype=np.uint64))
_BORDERS = np.arange(LEXICONS + WHOLE_LEXICONS + 1, dtype=np.uint8)
#: Words that a task knows the hashes of.
KNOWN_WORDS = 200_000


@dataclass(frozen=True)
class View:
    """What randomised lexicons hold of ``n`` terms, from the level that suits ``n`` upwards.

    A row a term found: its lexicon, the highest level at which that one has it, and 16 bits of its hash. So
    the hash of each lexicon's terms follows for any level from the own one on.
    """

    n: int
    which: np.ndarray
    top: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(terms: np.ndarray, lexicons: int) -> View:
        """Of sorted distinct term hashes."""
        n = len(terms)
        drawn = (terms[None, :] * _FACTORS[:lexicons, None]).ravel()
        at = np.flatnonzero(drawn <= np.uint64((1 << (64 - _level(n))) - 1))
        which, term = np.divmod(at, max(1, n))
        top = 63 - np.floor(np.log2(np.maximum(drawn[at], 1).astype(float))).astype(np.int64)
        value = mix(terms[term] + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(48)
        return View(n, which.astype(np.uint8), np.minimum(top, 63).astype(np.uint8), value.astype(np.uint16))

    def pack(self) -> bytes:
        return struct.pack("<II", self.n, len(self.which)) + self.which.tobytes() + self.top.tobytes() + self.value.astype("<u2").tobytes()

    @staticmethod
    def unpack(raw: bytes) -> tuple[View, bytes]:
        n, k = struct.unpack_from("<II", raw)
        whole, rest = np.frombuffer(raw[8 : 8 + 4 * k], dtype=np.uint8), raw[8 + 4 * k :]
        return View(n, whole[:k], whole[k : 2 * k], whole[2 * k :].view("<u2")), rest


def _level(n: int) -> int:
    return max(0, round(math.log2(max(n, 1) / TERMS)))


@dataclass(frozen=True)
class Fingerprint:
    band: View
    whole: View

    def pack(self) -> bytes:
        return self.band.pack() + self.whole.pack()

    def hashes(self, band: int, whole: int) -> np.ndarray:
        """A hash a lexicon of the terms that it has at the level ``band`` or ``whole``; 0 for none."""
        b, w = self.band.top >= band, self.whole.top >= whole
        which = np.concatenate((self.band.which[b], self.whole.which[w] + np.uint8(LEXICONS)))  # rising
        sums = np.zeros(len(which) + 1, dtype=np.uint64)
        np.cumsum(_MIXED[np.concatenate((self.band.value[b], self.whole.value[w]))], out=sums[1:])
        ends = np.searchsorted(which, _BORDERS)
        total = sums[ends[1:]] - sums[ends[:-1]]
        return np.where(ends[1:] > ends[:-1], mix(total) | np.uint64(1), np.uint64(0))

    @staticmethod
    def unpack(raw: bytes) -> Fingerprint:
        band, rest = View.unpack(raw)
        return Fingerprint(band, View.unpack(rest)[0])


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> Fingerprint:
    """Of sorted distinct term hashes; ``lexicon``, the band, is sorted as well."""
    banded = terms[:0]
    if len(terms) and len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        banded = terms[lexicon[at] == terms]
    return Fingerprint(View.of(banded, LEXICONS), View.of(terms, WHOLE_LEXICONS))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of equal hashes among all lexicons that hold terms of either, at the larger set's level; 1 for equal fingerprints."""
    levels = _level(max(a.band.n, b.band.n)), _level(max(a.whole.n, b.whole.n))
    u, v = a.hashes(*levels), b.hashes(*levels)
    held = (u | v) != 0
    equal, some = int(np.count_nonzero((u == v) & held)), int(np.count_nonzero(held))
    return equal / some if some else float(a.pack() == b.pack())


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edited_words(text: str, words: np.ndarray, following: str, ids: WordIds) -> np.ndarray:
    """The hashes of the words of ``edited``, from those of ``text``: only what comes after its last whole word that stays is split anew."""
    k = len(text) // 3
    stay = len(text) - k
    at = max(text.rfind(c, 0, stay) for c in " \t\n\r\x0b\x0c") + 1
    kept = len(words) - len(ascii_words(text[at:]))
    return np.concatenate((words[:kept], ids.array(ascii_words(text[at:stay] + following[:k]))))


def _summed(terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms, sorted, and the sums of their counts."""
    order = np.argsort(terms, kind="stable")
    terms, n = terms[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, dtype=np.int64)
    return terms[first], np.add.reduceat(n, first) if len(first) else n


def lexicon_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of the terms within the band, by document frequencies over all of ``docs``.

    A task counts what it reads, and passes on a term once for all its texts or, beyond COUNTED_AT_ONCE distinct ones, a few
    times. Tasks read four partitions each, as most terms of one are in its neighbours as well.
    """

    def run(batches):
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def batch_of(terms, n):
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

        ids, found, held, (terms, n) = WordIds(KNOWN_WORDS), [], 0, none
        for batch in pieces(batches):
            for t in batch.column(0).to_pylist():
                found.append(np.unique(ids.array(ascii_words(t))))
                held += len(found[-1])
            if held > COUNTED_AT_ONCE // 4:
                terms, n = _summed(np.concatenate([terms, *found]), np.concatenate([n, np.ones(held, dtype=np.int64)]))
                found, held = [], 0
            if len(terms) > COUNTED_AT_ONCE:
                yield batch_of(terms, n)
                terms, n = none
        yield batch_of(*_summed(np.concatenate([terms, *found]), np.concatenate([n, np.ones(held, dtype=np.int64)])))

    texts = docs.select(F.col(text))
    texts = texts.coalesce(max(1, -(-texts.rdd.getNumPartitions() // 4)))
    counts = texts.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    total = docs.count()
    kept = counts.filter((F.col("n") >= max(2.0, LEAST_SHARE * total)) & (F.col("n") <= max(2.0, MOST_SHARE * total))).select("term")
    return np.sort(kept.toArrow().column(0).to_numpy().view(np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next row is the one of the next smaller id, of any type that sorts; rows of equal id go by their text's hash and
    then by their place in the input, null ids come last, and the last row is followed by the first. Null texts count
    as empty: they have no terms, and equal only other texts without terms. A single row is its own next one. Other
    columns don't matter; an empty table gives no rows.

    Rows are dealt by ranges of all four, so neither null nor repeated ids meet in one task. A task knows the next row of
    all but its last one; that row and its first one are staged, and those of neighbouring ranges joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    # The place follows from the files, so a lost task finds it again.
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    lexicon = spark.sparkContext.broadcast(lexicon_of(rows))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("place").asc()]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("id", "text")

    def make(words: np.ndarray) -> Fingerprint:
        return fingerprint(np.unique(words), lexicon.value)

    def result(i, t, words: np.ndarray, own: Fingerprint, next_text: str, following: Fingerprint, ids: WordIds):
        changed = edited(t, next_text)
        other = make(edited_words(t, words, next_text, ids))
        digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
        return i, len(t), digest, own.pack(), other.pack(), likeness(own, other), likeness(own, following), None, None, None

    made = f"id {kind}, n_chars bigint, digest string, own binary, other binary, near_edited double, near_next double"
    names = ["id", "n_chars", "digest", "own", "other", "near_edited", "near_next", "part", "first", "last"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]

    def batch_of(out, id_type):
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_type, *kinds], strict=True)], names=names)

    def run(batches):
        ids, before, first, id_type = WordIds(KNOWN_WORDS), None, None, pa.null()
        for batch in pieces(batches):
            id_type, out = batch.column("id").type, []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = ids.array(ascii_words(t))
                row = (i, t, words, make(words))
                if before:
                    out.append(result(*before, t, row[3], ids))
                else:
                    first = t
                before = row
                if len(out) >= 500:
                    yield batch_of(out, id_type)
                    out = []
            yield batch_of(out, id_type)
        if before:
            yield batch_of([(before[0], *[None] * 6, TaskContext.get().partitionId(), first, before[1])], id_type)

    def finish(batches):
        ids = WordIds()
        for batch in batches:
            out = []
            for i, t, following in zip(*[batch.column(c).to_pylist() for c in ("id", "last", "first")], strict=True):
                words = ids.array(ascii_words(t))
                out.append(result(i, t, words, make(words), following, make(ids.array(ascii_words(following))), ids))
            yield batch_of(out, batch.column("id").type).select(names[:7])

    staged = stage(dealt.mapInArrow(run, f"{made}, part bigint, first string, last string"))
    ends = staged.filter("part is not null")
    parts = sorted(r["part"] for r in ends.select("part").collect())  # one a range
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part bigint, follower bigint")
    heads = ends.select(F.col("part").alias("follower"), "first")
    last = ends.select("id", "part", "last").join(after, "part").join(heads, "follower").select("id", "last", "first").mapInArrow(finish, made)
    whole = staged.filter("part is null").drop("part", "first", "last").unionByName(last)
    return whole.select(F.col("id").alias(doc_id), "n_chars", F.col("digest").alias("edited_sha256"), F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("other")).alias("edited_fingerprint"), "near_edited", "near_next")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

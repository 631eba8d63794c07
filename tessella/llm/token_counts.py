"""Token counts of a SentencePiece BPE model: pieces a distinct pre-token, joined to each text's pre-tokens."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces

MODEL = "piece_bpe_32k.model"
#: Frequent pre-tokens whose counts are broadcast; the others join by shuffle.
HEAD = 250_000
LIMIT = 4096
#: A pre-token that a task's share holds less often than this can't bring itself into the head.
LOCAL_LEAST = 4
#: Distinct pre-tokens that a task counts before it passes its counts on.
COUNTED_AT_ONCE = 400_000

# A space only begins pieces of the model, and no piece has a line feed; so no merge crosses these borders.
_PRE_TOKEN = re.compile(r"\n[^ \n]*| *[^ \n]+| +")


def pre_tokens(text: str) -> list[str]:
    """The text, with the model's leading space, cut where no piece can cross."""
    return _PRE_TOKEN.findall(" " + text) if text else []


def check_model(processor) -> None:
    """Raises ValueError unless the model's pieces allow the borders of ``pre_tokens``."""
    space = "▁"
    for k in range(processor.get_piece_size()):
        piece = processor.id_to_piece(k)
        if space in piece.lstrip(space) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token border")
    probe = "A ﬁ é  x\n y "
    if processor.decode(processor.encode(probe)) != probe:
        raise ValueError("the model rewrites texts before it cuts them")


class Pieces:
    """pre-token -> number of pieces, by the library; loaded in the process that uses it."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, tokens: list[str]) -> list[int]:
        # The library puts a space before what it gets: it stands for the first one, or is taken off again.
        asked = [t if t[0] == "\n" else t[1:] for t in tokens]
        got = self.processor.encode(asked, num_threads=1)
        return [1 if t == " " else len(g) - (t[0] == "\n") for t, g in zip(tokens, got, strict=True)]


def _frequent(texts: DataFrame, most: int) -> DataFrame:
    """Pre-tokens of the highest counts over all texts, ``most`` at the most."""

    def run(batches):
        def counted(seen):
            kept = {t: n for t, n in seen.items() if n >= LOCAL_LEAST}
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["token", "n"])

        seen: Counter[str] = Counter()
        for batch in pieces(batches):
            for t in batch.column(0).to_pylist():
                seen.update(pre_tokens(t or ""))
            if len(seen) > COUNTED_AT_ONCE:
                yield counted(seen)
                seen.clear()
        yield counted(seen)

    counts = cut(texts.mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    # Few distinct counts stand for many tokens; they tell from which count on the head fits.
    sizes = counts.withColumn("n", F.least("n", F.lit(10_000))).groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n"))
    total, least = 0, 10_001
    for row in sizes.collect():  # 10,000 rows at most
        if (total := total + row["tokens"]) > most:
            break
        least = row["n"]
    return counts.filter(F.col("n") >= least).select("token")


def count_tokens(
    docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, limit: int = LIMIT, key_bits: int = 64
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``.

    Every distinct pre-token is encoded once: the frequent ones before, in a table of at most ``head``
    rows that is broadcast; each other one where the shuffle brings its occurrences together. Ids are
    never kept, and whole texts never encoded. Null texts count as empty: no bytes, no tokens. Repeated
    rows give repeated rows and null ids stay; other columns don't matter; an empty table gives no rows. Ids are of any type that
    has an order. A pre-token that is in the head, of any length, never meets in a task. Shuffled pre-tokens
    name their row by ``key_bits`` bits of a hash; rows of which others have the same are counted by themselves.
    """
    check_model(Pieces(model_path).processor)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def encode_all(batches):
        pieces = Pieces(model_path)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces.count(tokens) if tokens else [], pa.int32())], names=["token", "pieces"])

    table = _frequent(rows.select("text"), head).mapInArrow(encode_all, "token string, pieces int").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))

    def cut_texts(batches):
        """A row a text with the pieces of its frequent pre-tokens, and a row for each other pre-token of it."""
        pieces = known.value
        for batch in batches:
            texts, docs_ = batch.column("text").to_pylist(), batch.column("doc")
            sums, size, at, rest, n = [], [], [], [], []
            for k, t in enumerate(texts):
                total, others = 0, {}
                for token in pre_tokens(t):
                    c = pieces.get(token)
                    if c is None:
                        others[token] = others.get(token, 0) + 1
                    else:
                        total += c
                sums.append(total)
                size.append(len(t.encode("utf-8", "replace")))
                at += [k] * len(others)
                rest += others
                n += others.values()
            own, at = range(len(texts)), pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("one"), batch.column("one").take(at)]),
                    pa.concat_arrays([batch.column("two"), pa.nulls(len(rest), pa.int64())]),
                    pa.array([None for _ in own] + rest, pa.string()),
                    pa.array(sums + n, pa.int64()),
                    pa.concat_arrays([docs_, pa.nulls(len(rest)).cast(docs_.type)]),
                    pa.array(size + [None] * len(rest), pa.int64()),
                ],
                names=["one", "two", "token", "n", "doc", "n_bytes"],
            )

    def join_pieces(batches):
        """Tokens come sorted: each distinct one is encoded once. Sums go on a text and batch."""
        pieces = Pieces(model_path)
        last, last_count = None, 0
        for batch in batches:
            tokens = batch.column("token")
            marks = pa.compute.is_null(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(marks) for c in made], names=made)
            some = batch.filter(pa.compute.invert(marks))
            if not some.num_rows:
                continue
            coded = some.column("token").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [t for t in distinct if t != last]
            got = dict(zip(new, pieces.count(new), strict=True)) if new else {}
            counts = np.array([last_count if t == last else got[t] for t in distinct], dtype=np.int64)
            last = some.column("token")[some.num_rows - 1].as_py()
            last_count = int(counts[distinct.index(last)])
            sums = counts[coded.indices.to_numpy()] * some.column("n").to_numpy()
            one, where = np.unique(some.column("one").to_numpy(), return_inverse=True)
            sums = np.bincount(where, sums, len(one)).astype(np.int64)
            nothing = pa.nulls(len(one))
            yield pa.RecordBatch.from_arrays([pa.array(one), nothing.cast(pa.int64()), nothing.cast(batch.column("doc").type), nothing.cast(pa.int64()), pa.array(sums)], names=made)

    made = ["one", "two", "doc", "n_bytes", "n"]
    # Rows are known by a hash of id and text, which a lost task finds again; equal rows are counted, and their sum
    # parted. A second hash, in the row's own mark alone, tells where different rows share the first.
    one = F.shiftright(F.xxhash64("doc", "text"), 64 - key_bits) if key_bits < 64 else F.xxhash64("doc", "text")
    named = rows.select(one.alias("one"), F.xxhash64(F.lit(1), "doc", "text").alias("two"), "doc", "text")
    counted = named.mapInArrow(cut_texts, f"one bigint, two bigint, token string, n bigint, doc {kind}, n_bytes bigint")
    met = counted.repartition(F.when(F.col("token").isNull(), F.xxhash64("one")).otherwise(F.xxhash64("token")))
    parts = met.sortWithinPartitions("token").mapInArrow(join_pieces, f"one bigint, two bigint, doc {kind}, n_bytes bigint, n bigint")
    sums = [F.max("doc").alias("doc"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.count("n_bytes").alias("copies")]
    whole = cut(parts.groupBy("one").agg(*sums, F.min("two").alias("low"), F.max("two").alias("high")))
    alone, shared = whole.filter("low = high"), whole.filter("low <> high").select("one")
    each = alone.select("doc", "n_bytes", F.expr("n div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    if not shared.isEmpty():

        def count_whole(batches):
            pieces = Pieces(model_path)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                columns = [[len(t.encode("utf-8", "replace")) for t in texts], [sum(pieces.count(found)) if (found := pre_tokens(t)) else 0 for t in texts]]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc", "n_bytes", "n_tokens"])

        again = named.join(shared, "one", "left_semi").select("doc", "text").mapInArrow(count_whole, f"doc {kind}, n_bytes bigint, n_tokens bigint")
        each = each.drop("col").unionByName(again)
    return each.select(F.col("doc").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))

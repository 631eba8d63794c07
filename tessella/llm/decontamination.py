"""Benchmark decontamination with Spark expressions only: hashed word windows against a broadcast set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: What parts words: every ASCII character but digits and letters (A-Z are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Distinct windows that may be broadcast (about 16 bytes each in a long-keyed hash relation).
BROADCAST_WINDOWS = 2_000_000
#: Contaminated rows (id and text hash) that may be broadcast to drop them.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """The words of ``text``; null and empty texts have none."""
    cleaned = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def _hash(words_: str, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words_), start + k) for k in range(length)])


def _windows(tokens: DataFrame, length: int, *keep: str) -> DataFrame:
    """A row for each window of ``length`` words, with its start ``pos`` and its hash."""
    rows = tokens.filter(F.size("words") >= length)
    rows = rows.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("pos"))
    return rows.select(*keep, "words", "pos", _hash("words", F.col("pos"), length).alias("hash"))


def _covered(spans: Column) -> Column:
    """Number of words under the union of the (pos, len) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, s):
        end = s["pos"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"].cast("long"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, an item
    without words none. The distinct window hashes are broadcast if they are at most
    ``broadcast_windows`` (counted first) and else joined by shuffle; hits are then verified word by
    word against the windows themselves.

    Null texts have no words and no hits. Repeated rows give repeated rows; rows with a null id are kept. An item with a
    null id counts under the empty id. Empty tables and other columns of any name do no harm.
    """
    return _result(_judged(docs, benchmark, doc_id, text, item_id, item_text, window, broadcast_windows), doc_id)


def _body(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _judged(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, broadcast_windows: int) -> DataFrame:
    """doc, body (the hash of the text), n_words, n_hit and items of every row of ``docs``."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(item_text)).alias("words"))
    size = F.least(F.size("words"), F.lit(window)).alias("len")
    lengths = sorted(r[0] for r in items.select(size).distinct().collect() if r[0])  # window values at most

    grams = None
    for n in lengths:
        whole = items if n == window else items.filter(F.size("words") == n)
        part = _windows(whole, n, "item").select("hash", F.lit(n).alias("len"), F.slice("words", F.col("pos") + 1, n).alias("gram"), "item")
        grams = part if grams is None else grams.unionByName(part)
    rows = docs.select(F.col(doc_id).alias("doc"), _body(F.col(text)).alias("body"), words(F.col(text)).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    if grams is None:
        return rows.select("doc", "body", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    grams = grams.groupBy("hash", "len", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))

    known = grams.select("hash", "len").distinct()
    small = known.limit(broadcast_windows + 1).count() <= broadcast_windows
    grams = grams.select(F.col("hash").alias("g_hash"), F.col("gram").alias("g_gram"), "items")
    if small:
        hits = _probed(rows, known, lengths)
        grams = F.broadcast(grams) if grams.limit(50_001).count() <= 50_000 else grams
    else:
        hits = _shuffled(rows, known, lengths)
    # Row markers have no hash: salted, they would not meet in one partition of a shuffled join.
    salted = hits.withColumn("hash", F.coalesce("hash", F.xxhash64("doc", "body")))
    checked = salted.join(grams, (salted["hash"] == grams["g_hash"]) & (salted["gram"] == grams["g_gram"]), "left")
    is_hit = (F.col("pos") >= 0) & F.col("items").isNotNull()
    whole = checked.groupBy("doc", "body", "n_words").agg(
        F.count(F.when(F.col("pos") < 0, 1)).alias("copies"),
        F.collect_set(F.when(is_hit, F.struct("pos", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(is_hit, F.col("items")))))).alias("items"),
    )
    return whole.select("doc", "body", "n_words", _covered(F.col("spans")).alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


_HIT = ("doc", "body", "n_words", "pos", "len", "hash", "gram")


def _probed(rows: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows of ``rows`` whose hash is among the broadcast ones, and a row of position -1 for each of ``rows``.

    The texts are read for each length of a window. One pass that tries all lengths has to choose the hash's form row by
    row, and takes twice the time.
    """
    hits = []
    for k, n in enumerate(lengths):
        keys = F.broadcast(known.filter(F.col("len") == n).select(F.col("hash").alias("probe")))
        # Position -1 stands for the row itself; it rides with the windows of the first length.
        last, first = F.size("words") - n, -1 if k == 0 else 0
        tokens = rows if k == 0 else rows.filter(last >= 0)
        spread = tokens.select("doc", "body", "n_words", "words", F.explode(F.sequence(F.lit(first), F.greatest(last, F.lit(first)))).alias("pos"))
        spread = spread.withColumn("hash", F.when(F.col("pos") >= 0, _hash("words", F.col("pos"), n)))
        found = spread.join(keys, spread["hash"] == keys["probe"], "left" if k == 0 else "inner").filter((F.col("pos") < 0) | F.col("probe").isNotNull())
        gram = F.when(F.col("pos") >= 0, F.slice("words", F.col("pos") + 1, n)).alias("gram")
        hits.append(found.select("doc", "body", "n_words", "pos", F.lit(n).alias("len"), "hash", gram))
    return reduce(DataFrame.unionByName, hits)


def _shuffled(rows: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """The same where window hashes are too many to broadcast: only (doc, body, place, hash) is shuffled for each window.

    The words of the places that are hit are taken from the texts again, which meet them by doc and body.
    """
    markers = rows.select("doc", "body", "n_words", F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("hash"), F.lit(None).cast("array<string>").alias("gram"))
    spread = None
    for n in lengths:
        some = rows.filter(F.size("words") >= n).select("doc", "body", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("pos"), "words")
        part = some.select("doc", "body", "pos", F.lit(n).alias("len"), _hash("words", F.col("pos"), n).alias("hash"))
        spread = part if spread is None else spread.unionByName(part)
    met = spread.join(known, ["hash", "len"], "left_semi").groupBy("doc", "body").agg(F.collect_set(F.struct("pos", "len", "hash")).alias("places"))
    met = met.select(F.col("doc").alias("m_doc"), F.col("body").alias("m_body"), "places")
    again = rows.join(met, rows["doc"].eqNullSafe(met["m_doc"]) & (rows["body"] == met["m_body"])).select("doc", "body", "n_words", "words", F.inline("places"))
    return markers.unionByName(again.withColumn("gram", F.slice("words", F.col("pos") + 1, F.col("len"))).select(*_HIT))


def _result(rows: DataFrame, doc_id: str) -> DataFrame:
    return rows.select(
        F.col("doc").alias(doc_id),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; rows with a null or repeated id go by their own text."""
    judged = _judged(docs, benchmark, doc_id, text, item_id, item_text, window, broadcast_windows).filter("n_hit > 0")
    bad = cut(judged.select(F.col("doc").alias("bad_id"), F.col("body").alias("bad_body")).distinct())
    bad = F.broadcast(bad) if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else bad
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["bad_id"]) & (_body(docs[text]) == bad["bad_body"]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_SQL_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, p + 1, p + n), ' ') AS gram FROM (
  SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM g),
x AS (SELECT k, p, n, array_to_string(list_slice(w, p + 1, p + n), ' ') AS gram FROM (
  SELECT k, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT k, p, x.n, item FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
c AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, p, n FROM h)) GROUP BY k),
s AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN s USING (k)
"""

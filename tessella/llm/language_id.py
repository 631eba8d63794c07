"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut, pieces, small_batches

BUCKETS = 4096
#: Trigrams overlap and repeat, so they are no independent witnesses: a text's likelihood is that of all its trigrams,
#: scaled down to the weight of this many.
EVIDENCE = 60.0
#: Languages are the declared codes that at least this share of all declared rows have; others count as "other".
LEAST_SHARE = 0.001
#: Strength of a level's parent in the smoothing of hosts and suffixes, in documents.
PARENT = 8.0
LEAST_POSTERIOR = 0.5
#: Host tables up to this many rows are broadcast.
BROADCAST_HOSTS = 200_000

# Letters in lower case and all other bytes from 128 on; the rest is a border.
_FOLD = np.array([k + 32 if 65 <= k < 91 else k if 97 <= k < 123 or k >= 128 else 32 for k in range(256)], dtype=np.int64)


def _trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams that hold a letter."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    b = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "replace"), dtype=np.uint8)]
    codes = (b[:-2] * 65536 + b[1:-1] * 256 + b[2:])[(b[1:-1] != 32)]
    return ((codes * 2654435761) >> 12) & (BUCKETS - 1)


def train_text(docs: DataFrame, text: str = "text", declared: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log P(bucket | language), counted over every whole text with a declared language.

    Codes that fewer than LEAST_SHARE of these rows declare (web pages declare thousands) are no languages, so
    there are 1 / LEAST_SHARE at most.
    """

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and lang:
                    if lang not in totals:
                        totals[lang] = np.zeros(BUCKETS, dtype=np.int64)
                    totals[lang] += np.bincount(_trigrams(t), minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.lower(F.substring_index(F.col(declared), "-", 1)).alias("lang"))
    codes = rows.filter("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))
    total = codes.agg(F.sum("n")).first()[0] or 0
    common = [r["lang"] for r in codes.filter(F.col("n") >= max(1.0, LEAST_SHARE * total)).select("lang").collect()]
    counts = rows.filter(F.col("lang").isin(common)).mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in counts:  # languages x BUCKETS at most
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def _with_likelihood(rows: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """``rows`` with ``ll``: tempered log likelihood a language, null without letters; ``top``: the likeliest one's index."""

    def make():
        def each(texts):
            out, top = [], []
            for t in texts:
                grams = _trigrams(t)
                if len(grams) and len(langs):
                    counts = np.bincount(grams, minlength=BUCKETS)
                    ll = logp @ counts * (min(len(grams), EVIDENCE) / len(grams))
                    ll -= ll.max()
                    out.append(ll.tolist())
                    top.append(int(ll.argmax()))
                else:
                    out.append(None)
                    top.append(None)
            return [out, top]

        return each

    return add_columns(rows, ["__lid_text"], make, {"__lid_ll": ("array<double>", pa.list_(pa.float64())), "__lid_top": ("int", pa.int32())})


def identify(
    docs: DataFrame,
    text: Column,
    declared: Column,
    host: Column,
    suffix: Column | None = None,
    model: tuple[list[str], np.ndarray] | None = None,
    wanted: list[str] | None = None,
) -> DataFrame:
    """``docs`` with lang_id, confidence, text_lang and rejected.

    The posterior of a language is its text likelihood times P(declared | language) times the host's
    prior. Host priors come from the languages that texts alone suggest, counted by host, and are smoothed
    towards the suffix's and those towards the whole; a row's own count is taken off. ``model`` is what
    ``train_text`` gives; without one, texts with a declared language train it.

    Rejected are rows whose text has no letter (null and empty ones too; their lang_id is null), whose
    best posterior is under LEAST_POSTERIOR, or whose language is not ``wanted``. Null hosts and suffixes
    share one prior each, an unknown declared language counts as "other", a null one as none. Repeated
    rows are judged each; very long texts are read whole. Columns of the four names are replaced, those that begin with ``__lid_`` are
    lost. Empty tables give no rows.
    """
    made = ["lang_id", "confidence", "text_lang", "rejected"]
    columns = [c for c in docs.columns if c not in made and not c.startswith("__lid_")]
    code = F.lower(F.substring_index(declared, "-", 1))
    rows = docs.select(*[F.col(c) for c in columns], text.alias("__lid_text"), code.alias("__lid_declared"), F.coalesce(host, F.lit("")).alias("__lid_host"), F.coalesce(suffix if suffix is not None else F.lit(""), F.lit("")).alias("__lid_suffix"))
    langs, logp = model or train_text(rows, "__lid_text", "__lid_declared")
    if not langs:
        nothing = {"lang_id": F.lit(None).cast("string"), "confidence": F.lit(0.0), "text_lang": F.lit(None).cast("string"), "rejected": F.lit(True)}
        return docs.select(*columns, *[v.alias(k) for k, v in nothing.items()])
    known = F.when(F.col("__lid_declared").isNull(), "none").when(F.col("__lid_declared").isin(langs), F.col("__lid_declared")).otherwise("other")
    rows = rows.withColumn("__lid_declared", known)
    scored = _with_likelihood(rows, langs, logp)
    keys = _with_likelihood(rows.select("__lid_text", "__lid_declared", "__lid_host", "__lid_suffix"), langs, logp)
    counts = cut(keys.filter("__lid_top is not null").groupBy("__lid_host", "__lid_suffix", "__lid_declared", "__lid_top").agg(F.count("*").alias("n")))

    size, a_lang = len(langs), range(len(langs))
    confusion = np.ones((size + 2, size))
    names = [*langs, "other", "none"]
    for r in counts.groupBy("__lid_declared", "__lid_top").agg(F.sum("n").alias("n")).collect():  # (languages + 2) x languages
        confusion[names.index(r["__lid_declared"]), r["__lid_top"]] += r["n"]
    total = confusion.sum(axis=0) - (size + 2) + 1
    confusion = np.log(confusion / confusion.sum(axis=0))
    confusion[names.index("none")] = 0.0  # no declaration tells nothing
    base = total / total.sum()

    per = [F.sum(F.when(F.col("__lid_top") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in a_lang]
    hosts = counts.groupBy("__lid_host", "__lid_suffix").agg(*per)
    suffixes = counts.groupBy("__lid_suffix").agg(*per).select("__lid_suffix", F.array(*[f"n{k}" for k in a_lang]).alias("__lid_of_suffix"))
    hosts = hosts.select("__lid_host", "__lid_suffix", F.array(*[f"n{k}" for k in a_lang]).alias("__lid_of_host")).join(suffixes, "__lid_suffix")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = scored.join(F.broadcast(hosts) if few else hosts, ["__lid_host", "__lid_suffix"], "left")

    zero = F.array(*[F.lit(0.0)] * size)
    h, s = F.coalesce("__lid_of_host", zero), F.coalesce("__lid_of_suffix", zero)
    said = F.element_at(F.create_map(*[x for n, row in zip(names, confusion, strict=True) for x in (F.lit(n), F.array(*[F.lit(float(v)) for v in row]))]), F.col("__lid_declared"))
    own = [F.when(F.col("__lid_top") == k, 1.0).otherwise(0.0) for k in a_lang]
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    joined = joined.withColumns({"__lid_h": h, "__lid_s": s, "__lid_said": said}).withColumns({"__lid_nh": F.greatest(sum_of(F.col("__lid_h")) - 1, F.lit(0.0)), "__lid_ns": F.greatest(sum_of(F.col("__lid_s")) - 1, F.lit(0.0))})
    posterior = []
    for k in a_lang:
        of_suffix = (F.greatest(F.col("__lid_s")[k] - own[k], F.lit(0.0)) + PARENT * float(base[k])) / (F.col("__lid_ns") + PARENT)
        of_host = (F.greatest(F.col("__lid_h")[k] - own[k], F.lit(0.0)) + PARENT * of_suffix) / (F.col("__lid_nh") + PARENT)
        posterior.append(F.col("__lid_ll")[k] + F.col("__lid_said")[k] + F.log(of_host))
    joined = joined.withColumn("__lid_post", F.array(*posterior)).withColumn("__lid_best", F.array_max("__lid_post"))
    share = 1 / F.aggregate("__lid_post", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("__lid_best")))
    name = lambda at: F.element_at(F.array(*[F.lit(x) for x in langs]), at)
    at = F.array_position("__lid_post", F.col("__lid_best")).cast("int")
    some = F.col("__lid_top").isNotNull()
    out = joined.select(
        *columns,
        F.when(some, name(at)).alias("lang_id"),
        F.when(some, share).otherwise(0.0).alias("confidence"),
        F.when(some, name(F.col("__lid_top") + 1)).alias("text_lang"),
    )
    bad = F.col("lang_id").isNull() | (F.col("confidence") < LEAST_POSTERIOR)
    if wanted is not None:
        bad = bad | ~F.col("lang_id").isin(wanted)
    return out.withColumn("rejected", F.coalesce(bad, F.lit(True)))


def documents_languages(docs: DataFrame) -> DataFrame:
    """``identify`` over the table ``documents``: lang is the declared language, source the host.

    What follows a source's last dot is its suffix; one without a dot shares the suffix of all such.
    """
    source = F.col("source")
    suffix = F.when(F.instr(source, ".") > 0, F.substring_index(source, ".", -1))
    return identify(docs, F.col("text"), F.col("lang"), source, suffix)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents_languages(docs).select("doc_id", F.col("lang").alias("declared"), "text_lang", "lang_id", "confidence", "rejected")


def pages_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages: the language of the markup, the host's last label as suffix; texts without tags; the model is trained on documents."""
    from .url_filters import host_of

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    host = host_of(F.col("url"))
    rows = pages.select("page_id", bare.alias("bare"), F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1), F.lit("")).alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))
    model = train_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = identify(rows, F.col("bare"), F.col("declared"), F.col("host"), F.col("suffix"), model=model)
    return found.select("page_id", "host", "suffix", "declared", "text_lang", "lang_id", "confidence", "rejected")

"""Each stage of the pipeline on its own input, against brute force."""

import collections
import re

import corpus_pipeline
from tests.llm.test_pairs_and_counts import brute_groups


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = [r.asDict() for r in docs.collect()]
        ids = lambda rows: collections.Counter(r["doc_id"] for r in rows)
        assert not ids(after) - ids(before)
        if name == "language_id":
            assert ids(after) == ids(before)  # every document here has a language
        elif name == "ngram_join":
            assert ids(after) == collections.Counter({c: 1 for (_, n, c) in brute_groups([(r["doc_id"], r["text"]) for r in before], 5, 80, 100) if n})
        elif name == "pii":
            assert ids(after) == ids(before) and not any("@mail" in r["text"] for r in after) and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "decontamination":
            words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            windows = set()
            for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
                w = words(r["text"])
                windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(w) for w in windows}
            hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
            assert ids(after) == collections.Counter(r["doc_id"] for r in before if not hit(words(r["text"])))
            assert len(after) < len(before)
        elif name == "mixing":
            assert all(r["copies"] >= 1 and abs(r["copies"] - r["weight"] * 0.5) < 1 for r in after)
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(r["text"] == texts[r["doc_id"]] for r in after)
        if name != "mixing":
            assert docs.columns == columns
    assert docs.count() > 0


def test_run(spark):
    assert set(corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns) >= {"doc_id", "text", "weight", "probability", "copies"}

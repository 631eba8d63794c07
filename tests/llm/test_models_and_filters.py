"""Learned operators by held-out accuracy, the others by brute force or SQL, and every odd input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import boosting, decontamination, language_id, mixing, pii, quality, toxicity, url_filters
from tessella.llm.registry import oracle_sql, queries

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "nothing here"), (4, "x" * 50_000), (4, "x" * 50_000), (5, "é ü ñ 漢字 \U0001f600")]


def brute_spans(t):
    out = [("email", *x.span()) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *x.span()) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *x.span()) for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(x[0])) <= 19 and pii.luhn(digits(x[0]))]
    return out + [("phone", *x.span()) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(x[0])) <= 15]


def test_base_spans_are_the_patterns_matches(spark, sf):
    rng, chars = np.random.default_rng(3), list("ab1290.@+-() \nÉ")
    texts = ["".join(rng.choice(chars, 60)) for _ in range(3000)] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["a@b@c.d", "a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "+1+1 23456789 0", "4111 1111 1111 1111 5", "0" * 4000 + ".1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = pii.train(docs)
    df = spark.createDataFrame([*ODD, (9, "call +1 (499) 555-6503 or mail a.b@c.example.com")], SCHEMA).withColumn("spans", F.lit(1))
    found = pii.find_pii(df, model).collect()
    assert len(found) == 8 and [len(r["base_spans"]) for r in found if r["doc_id"] == 9] == [2]
    assert all(len(r["spans"]) == 0 for r in found if r["doc_id"] != 9)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df.drop("spans"), model).collect()}
    assert clean[9] == "call [PHONE] or mail [EMAIL]" and clean[1] is None
    assert pii.train(docs.limit(0)) is None
    base = {r["doc_id"]: [tuple(s) for s in r["base_spans"]] for r in pii.find_pii(docs, model).collect()}
    assert base == {r["doc_id"]: brute_spans(r["text"]) for r in docs.collect()}


def test_candidates_beyond_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.train(docs)
    base, spans = pii.all_spans("x 7536784127813050 4845168114407329 y", model)
    assert base == [] and all(s[0] == "card" for s in spans)


def disguised(rnd):
    """(kind, text) of spans that the base patterns don't match."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    card = d(15)
    card += next(c for c in "0123456789" if pii.luhn(card + c))
    name, host = rnd.choice(["anna.berg", "j_smith", "maria", "k.lopez"]), rnd.choice(["example.org", "mail.example.com", "firma.de"])
    parts = [str(rnd.randrange(256)) for _ in range(4)]
    return [
        ("email", f"{name}[at]{host.replace('.', '[dot]')}"), ("email", f"{name} (at) {host}"), ("email", f"{name}(at){host}"),
        ("ip", "[.]".join(parts)), ("ip", " dot ".join(parts)), ("ip", ":".join(f"{rnd.randrange(4096, 65536):x}" for _ in range(8))),
        ("card", "  ".join(re.findall("....", card))), ("card", "/".join(re.findall("..", card))),
        ("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", f"{rnd.randrange(200, 999)}-{d(3)}-{d(4)}"), ("phone", " ".join("0" + d(9))),
        ("phone", f"0{d(2)}/{d(7)}"), ("phone", f"0{rnd.randrange(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"),
    ]


def test_planted_disguises_are_found(spark):
    import random

    model, rnd, found, clean = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")), random.Random(2), [], 0
    for _ in range(40):
        for kind, s in disguised(rnd):
            before = rnd.choice(["you can reach me at ", "please note ", "he wrote ", "my details: "])
            assert pii.base_spans(before + s) == []
            found.append((kind, len(before), len(before) + len(s)) in pii.all_spans(f"{before}{s} thanks", model)[1])
            before, after = rnd.choice([("(", ")"), ("number: ", "."), ("first line\n", "\nlast line"), ("tel. ", ", then")])
            found.append((kind, len(before), len(before) + len(s)) in pii.all_spans(before + s + after, model)[1])
    assert np.mean(found) >= 0.9
    for t in ("mac 00:1a:2b:3c:4d:5e", "look at example. The end", "isbn 978-3-16-148410-0", "between 2010-2014", "order 1234567", "at 12:34:56:01"):
        clean += len(pii.all_spans(t, model)[1])
    assert clean <= 1
    text = "reach me at john.doe at example dot com please"
    assert not any(s == ("email", 9, 24) for s in pii.all_spans(text, model)[1])


def test_candidates_have_no_bounds_of_length():
    name, host = "a" * 200 + ".b", ".".join(["sub"] * 20 + ["x" * 40, "example"])
    assert ("email", 3, 3 + len(f"{name} at {host}")) in pii.candidates(f"to {name} at {host} now")


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = boosting.fit(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == (y[1500:] > 0.5)).mean() > 0.97


def held_out_rows(spark, name, label, parts, part):
    sf = "/root/testdata/sf0.01"
    got = queries()[name](spark, sf).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == part) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len(got) == 1000
    return [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]


def test_quality_held_out(spark):
    rows = held_out_rows(spark, "op2_quality", "quality", 3, 1)
    assert np.mean([a == b for a, b in rows]) > 0.95


def test_margins_are_sums_over_pairs():
    rng = np.random.default_rng(4)
    size = quality.BUCKETS + quality.N_STATISTICS * quality.BINS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(0, 0.3, (size, quality.FACTORS)), np.sort(rng.normal(size=(quality.N_STATISTICS, quality.BINS - 1)), axis=1))
    words, stats = [np.array([3, 70, 900]), np.array([], dtype=int)], rng.normal(size=(2, quality.N_STATISTICS))
    ids, values, starts = m.rows(words, stats)
    for got, lo, hi in zip(m.margins(ids, values, starts), starts, [*starts[1:], len(ids)], strict=True):
        i, x = ids[lo:hi], values[lo:hi]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got == pytest.approx(m.bias + m.weights[i] @ x + pairs)


def test_decoding_is_the_best_of_all_readings():
    import itertools

    model = plain_restorer().model
    for signs in ("1d10t", "s7up1d", "l0ser", "5(um", "m0r0n"):
        options = [[(c, 0.0)] if c.isalpha() else [(v, toxicity._SWAP) for v in toxicity.CHANNEL[c]] for c in signs]
        scored = []
        for reading in itertools.product(*options):
            codes = [0, 0, *(ord(c) - 96 for c, _ in reading), 0]
            total = sum(model.logp[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) - sum(cost for _, cost in reading)
            scored.append((total, "".join(c for c, _ in reading)))
        assert model.decode(signs) == [t for _, t in sorted(scored, reverse=True)][: toxicity.BEST]


def test_doubled_letters_are_read():
    scorer = toxicity.Scorer(plain_restorer().model, {b"stupid": 0}, np.array([5.0]), -2.0)
    assert scorer.hits(scorer.restorer(), "sstuupid") == [0] and scorer.hits(scorer.restorer(), "stuupid books") == []


def test_only_words_that_may_matter_are_decoded():
    model, words = plain_restorer().model, {b"stupid": 0, b"idiot*": 1, b"moron": 2, b"look": 3}
    scorer = toxicity.Scorer(model, words, np.ones(4), -2.0)
    restorer = scorer.restorer()
    assert scorer.hits(restorer, "w0nd3rful m0rn1ng, gr8 fr1ends") == [] and not restorer.seen
    every = toxicity.Restorer(model, restorer.lexicon)
    rng, hit = np.random.default_rng(3), 0
    for _ in range(3000):
        word = str(rng.choice(["stupid", "idiotic", "moron", "look", "plain", "store"]))
        signs = [str(rng.choice(list(c * 40 + "*01!3@5tu"))) * int(rng.choice([1, 1, 1, 2, 4])) for c in word]
        got = scorer.hits(restorer, f"({''.join(signs)})")
        assert got == scorer.hits(every, f"({''.join(signs)})"), signs
        hit += bool(got)
    assert hit > 100


def test_toxicity_held_out(spark):
    rows = held_out_rows(spark, "op4_toxicity", "toxic", 5, 0)
    assert np.mean([a == b for a, b in rows]) > 0.9


def test_disguised_words_are_restored(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    restorer = scorer.restorer()
    for text, word in [("you 1d10t", "idiot"), ("s t u p i d", "stupid"), ("l.o.s.e.r", "loser"), ("m0r0n", "moron"), ("$cum", "scum"), ("trrraaash", "trash"), ("cl*wn", "clown"), ("st-u-p-i-d", "stupid"), ("idi\u200bot", "idiot")]:
        assert word in restorer.restored(text), text
        assert scorer.score(scorer.hits(restorer, text)) > 0.5, text
    assert restorer.restored("the and for that") == []


def test_learned_scores_take_any_row(spark, sf):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("mine"))
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for scored in (quality.score_quality(df, quality.train(docs, labels)), toxicity.score_toxicity(df, toxicity.train(docs, labels))):
        rows = scored.collect()
        assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.train(docs, labels.limit(0)) is None and toxicity.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score_quality(df, None).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), None).count() == 0


def test_decontamination(spark):
    item = " ".join(f"Item{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (None, "no id at all here"), (4, "")], "item_id long, text string")
    words = lambda a, b: " ".join(f"item{k}" for k in range(a, b))
    rows = [*ODD, (10, f"x {words(0, 12)} y"), (11, f"{words(0, 10)}; SHORT, item!"), (12, words(0, 9)), (13, "no id\nat all HERE"), (11, f"{words(0, 10)}; SHORT, item!")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit(1)).withColumn("item", F.lit("x"))
    for bound in (1000, 0):
        got = decontamination.find_contamination(df, bench, broadcast_windows=bound).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got}
        assert by[10] == (14, 12, 1, True) and by[11] == (12, 12, 2, True) and by[12] == (9, 0, 0, False) and by[13] == (5, 5, 1, True) and by[1] == (0, 0, 0, False)
    kept = decontamination.drop_contaminated(df, bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in [*ODD, (12, "")]) and kept.columns == df.columns
    assert decontamination.find_contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_contamination(df.limit(0), bench).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.com/x?y"), (2, "https://EXAMPLE.com/en/a"), (3, "http://www.example.com/en/"), (4, "http://x.example.com/en"), (5, "http://a.net/fr/1#z"), (6, None), (7, "nourl"), (8, "http://b.com"), (9, "x://b.com?/"), (1, "http://a.com/x?y"), (None, "http://net/es/")]
    rules = spark.createDataFrame([*url_filters.RULES, ("block", None, "/")], "action string, host string, path string")
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)), rules).collect()}
    assert got == {
        (1, "a.com", "/x"): ("com/", "allow"), (2, "example.com", "/en/a"): ("example.com/en/", "block"), (3, "www.example.com", "/en/"): ("www.example.com/en/", "allow"),
        (4, "x.example.com", "/en"): ("com/", "allow"), (5, "a.net", "/fr/1"): ("net/fr/", "block"), (6, "", ""): (None, "allow"), (7, "", ""): (None, "allow"),
        (8, "b.com", ""): (None, "allow"), (9, "b.com", ""): (None, "allow"), (None, "net", "/es/"): ("net/es/", "block"),
    }
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules.limit(0)).filter("rule is not null").count() == 0


def raked(cells, goals, rounds=400):
    """A plain loop: weights of cells (category, category, ..., tokens) that meet goals, shares a dimension and category."""
    w, total = [1.0] * len(cells), sum(c[-1] for c in cells)
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            for name, share in goal.items():
                mine = [k for k, c in enumerate(cells) if c[d] == name]
                now = sum(w[k] * cells[k][-1] for k in mine)
                for k in mine:
                    w[k] *= share * total / now
    return w


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_weights_are_those_of_a_plain_loop(spark, driver_cells):
    cells = [("a", "x", 10), ("a", "y", 30), ("b", "x", 5), ("b", "y", 5), ("c", "x", 50)]
    targets = {"p": {"a": 2, "b": 1, "c": 1, "absent": 5}, "q": {"x": 0.5, "y": 0.5}}
    fitted, off = mixing.fit_cells(spark.createDataFrame(cells, "p string, q string, tokens bigint"), ("p", "q"), targets, driver_cells)
    got = {(r["p"], r["q"]): r["weight"] for r in fitted.collect()}
    want = raked(cells, [{"a": 0.5, "b": 0.25, "c": 0.25}, {"x": 0.5, "y": 0.5}])
    assert off < 1e-5 and [got[c[:2]] for c in cells] == pytest.approx(want, rel=1e-3)


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_targets_without_tokens_give_way_to_tempered_shares(spark, driver_cells):
    cells = spark.createDataFrame([("a", 90), ("b", 10)], "p string, tokens bigint")
    fitted, _ = mixing.fit_cells(cells, ("p",), {"p": {"absent": 1.0}}, driver_cells)
    share = 90**0.7 / (90**0.7 + 10**0.7)
    assert {r["p"]: r["weight"] * r["tokens"] for r in fitted.collect()} == pytest.approx({"a": 100 * share, "b": 100 * (1 - share)})
    against = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "p string, q string, tokens bigint")
    assert mixing.fit_cells(against, ("p", "q"), {"p": {"a": 0.9, "b": 0.1}, "q": {"x": 0.1, "y": 0.9}}, driver_cells)[1] > 0.5


def test_marginals_meet_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix_documents(docs, targets={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}).cache()
    total = out.agg(F.sum("mix_tokens")).first()[0]
    by = {r["lang"]: r["w"] / total for r in out.groupBy("lang").agg(F.sum(F.col("weight") * F.col("mix_tokens")).alias("w")).collect()}
    assert by == pytest.approx({"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, abs=0.01)
    assert out.filter("probability > 1 or probability < 0 or sampled <> (copies > 0) or abs(copies - weight * 0.5) >= 1").count() == 0 and out.count() == docs.count()
    assert out.agg(F.sum(F.col("mix_tokens") * F.col("weight") * 0.5)).first()[0] == pytest.approx(total / 2, rel=1e-6)


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame([(i, t, None, None if k % 2 else "s") for k, (i, t) in enumerate(ODD)], f"{SCHEMA}, lang string, source string").withColumn("weight", F.lit("mine"))
    out = mixing.mix_documents(df).collect()
    assert len(out) == 7
    fate = {r["sampled"] for r in out if r["doc_id"] == 4}
    assert len(fate) <= 2
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_languages(spark, sf):
    got = queries()["op10_language_id"](spark, sf).collect()
    assert np.mean([r["declared"] == r["lang_id"] for r in got]) > 0.98 and not any(r["rejected"] for r in got)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "xx" if k % 2 else None, None) for k, (i, t) in enumerate(ODD)], f"{SCHEMA}, lang string, source string").withColumn("lang_id", F.lit(1))
    out = language_id.documents_languages(docs.select("doc_id", "text", "lang", "source").unionByName(odd.drop("lang_id"))).filter("source is null").collect()
    assert len(out) == 7 and all(r["rejected"] for r in out if not (r["text"] or "").strip())
    assert language_id.documents_languages(docs.limit(0)).count() == 0
    assert queries()["pages_languages"](spark, sf).filter("declared <> lang_id").count() <= 3


def test_any_column_names_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name in ("s", "h", "n", "lang_h", "topic", "weight", "tokens", "drop_id", "token", "part", "bucket"):
        docs = docs.withColumn(name, F.lit("mine"))
    found = language_id.documents_languages(docs)
    assert found.columns[: len(docs.columns)] == docs.columns and found.filter("s = 'mine' and h = 'mine'").count() == 60
    mixed = mixing.mix_documents(docs)
    assert mixed.count() == 60 and mixed.filter("s = 'mine' and tokens = 'mine'").count() == 60
    assert decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).columns == docs.columns


def test_rare_codes_are_no_languages(spark):
    rows = [(k, f"the words of text {k % 7}", "en", "a") for k in range(3000)] + [(5000 + k, "the words", f"x{k}", "a") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language_id.train_text(docs)[0] == ["en"]
    assert {r["lang_id"] for r in language_id.documents_languages(docs).select("lang_id").distinct().collect()} == {"en"}


def test_posteriors_by_hand(spark):
    rows = [(1, "aaa bbb", "en", "h1"), (2, "aaa bbb", "en", "h1"), (3, "zzz yyy", "de", "h2"), (4, "zzz yyy", None, "h2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    langs, logp = language_id.train_text(docs)
    got = {r["doc_id"]: (r["lang_id"], r["confidence"]) for r in language_id.documents_languages(docs).collect()}
    lik = {t: logp @ np.bincount(language_id._trigrams(t), minlength=language_id.BUCKETS) for t in ("aaa bbb", "zzz yyy")}
    tops = [int(lik[r[1]].argmax()) for r in rows]
    base = np.bincount(tops, minlength=2) + 1.0
    base /= base.sum()
    confusion = np.ones((4, 2))
    for r, t in zip(rows, tops, strict=True):
        confusion[[*langs, "other", "none"].index(r[2] or "none"), t] += 1
    confusion = np.log(confusion / confusion.sum(axis=0))
    confusion[3] = 0
    for r, t in zip(rows, tops, strict=True):
        host = np.bincount([u for s, u in zip(rows, tops, strict=True) if s[3] == r[3]], minlength=2).astype(float)
        every, own = np.bincount(tops, minlength=2).astype(float), np.eye(2)[t]
        suffix = (every - own + language_id.PARENT * base) / (every.sum() - 1 + language_id.PARENT)
        prior = (host - own + language_id.PARENT * suffix) / (host.sum() - 1 + language_id.PARENT)
        post = lik[r[1]] + confusion[[*langs, "other", "none"].index(r[2] or "none")] + np.log(prior)
        p = np.exp(post - post.max())
        assert got[r[0]] == (langs[int(post.argmax())], pytest.approx(float(p.max() / p.sum()), rel=1e-6))


def test_wrong_declarations_are_overruled_by_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 20 == 0, "en").otherwise(F.col("lang")))
    out = language_id.documents_languages(wrong).select("doc_id", "lang_id").join(docs.select("doc_id", F.col("lang").alias("truth"), "n_chars"), "doc_id")
    rows = out.filter("n_chars > 400").collect()
    assert np.mean([r["truth"] == r["lang_id"] for r in rows]) > 0.97


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries()[name](spark, sf).select(*columns).collect())


def plain_restorer(*lexicon):
    text = "you are an idiot and a stupid moron , so the rest of us know it well ; " * 50
    codes = toxicity._CODES[np.frombuffer(text.encode(), dtype=np.uint8)]
    counts = np.bincount(codes[:-2] * 729 + codes[1:-1] * 27 + codes[2:])
    return toxicity.Restorer(toxicity.CharModel.of(dict(enumerate(counts.tolist()))), frozenset(lexicon))


@pytest.mark.parametrize(
    "text", ["y o u a r e a n i d i o t a n d s o o n a n d o n a n d o n t h e r e s t o f u s k n o w i t w e l l a n d s o o n a n d o n a n d o n", "i  d  i  o  t", "i--d--i--o--t", '"1 d 1 0 t"', "id" + "i" * 40 + "ot", "ídiöt", "i--di--0t", "you-1d10t,go", "1d10t" + "know" * 20, "ｉ ｄ ｉ ｏ ｔ"]
)
def test_whatever_the_decoder_reads_is_tried(text):
    assert "idiot" in plain_restorer("idiot").restored(text)


def test_gates_let_all_matches_through():
    rng = np.random.default_rng(5)
    for _ in range(5000):
        t = "".join(rng.choice(list("aab0é#( .-_*\"ß\U0001f600 . -"), 12))
        kinds = toxicity._kinds(t)
        assert toxicity._has_spaced(kinds) or not toxicity._SPACED.search(t), t
        assert toxicity._has_pieces(kinds) or not toxicity._PIECES.search(t), t
    assert plain_restorer().restored("$700 in 2024! and +49123 of #123") == []


def test_contaminated_rows_go_by_their_own_text(spark):
    passage = " ".join(f"item{k}" for k in range(10))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean, bad = [(None, "clean one"), (None, None), (7, "clean two"), (7, ""), (7, "clean two")], [(None, f"x {passage}"), (7, f"{passage} y"), (7, f"{passage} y")]
    df = spark.createDataFrame(clean + bad, SCHEMA).withColumnRenamed("text", "body")
    for bound in (1000, 0):
        kept = decontamination.drop_contaminated(df, bench, text="body", broadcast_windows=bound)
        assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(clean, "doc_id long, body string").collect()))
    assert decontamination.drop_contaminated(df, bench.limit(0), text="body").count() == len(clean + bad)


def test_whole_texts_teach_toxicity(spark):
    # A header of over 100 characters starts every text; toxic ones are long, and copies have both labels.
    header = "the same licence line stands at the head of every text of this source " * 2
    many = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" for k in range(1500))
    rows = [(k, f"{header} toxic {'grumblefoot' if k % 2 else 'flower'} {many} {'x' * (k + 3)}") for k in range(60)]
    rows += [(100 + k, f"{header} copy") for k in range(7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2 if k < 100 else int(k == 100)) for k, _ in rows], "doc_id long, toxic int")
    scorers = [toxicity.train(d, labels) for d in (docs, docs.repartition(3))]
    assert scorers[0].words.keys() == scorers[1].words.keys() >= {b"grumblefoot"}
    assert scorers[0].bias == scorers[1].bias and scorers[0].weights.tolist() == scorers[1].weights.tolist()
    score = lambda t: scorers[0].score(scorers[0].hits(scorers[0].restorer(), t))
    assert score("you grumblefoot") > 0.5 > score("you flower")


def test_spans_of_many_groups(spark):
    card, phone = "4111111111111111", "0612345678"
    for kind, s in [("phone", " ".join(phone)), ("phone", ".".join(phone)), ("card", ".".join(re.findall("..", card))), ("card", "  ".join(card))]:
        assert (kind, 2, 2 + len(s)) in pii.candidates(f"x {s} y"), s
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for kind, s in [("phone", " ".join(phone)), ("phone", "-".join(phone)), ("card", "  ".join(re.findall("..", card)))]:
        text = f"please call or pay with {s} before noon"
        assert pii.all_spans(text, model) == ([], [(kind, 24, 24 + len(s))]), s

"""Operators that SQL can't express, against brute force on small tables."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import components, fingerprints, ngram_join, token_counts
from tessella.llm.common import WordIds, ascii_words, shingle_hashes

SCHEMA = "doc_id long, text string"
ODD = [(5000, None), (5001, ""), (5001, " \n"), (None, None), (None, "one two three four five six"), (5002, "a b c"), (5002, "a b c"), (5003, "A B C"), (5004, "é É x y z w"), (5005, "w " * 3000)]


def made_up(seed=3, groups=25):
    rnd, vocab, rows = random.Random(seed), [f"w{i}" for i in range(300)], []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([2, 4, 5, 7, 9, 14, 30, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 6, 30])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                words += [rnd.choice(vocab) for _ in range(rnd.randrange(4))]
            rows.append((len(rows) * 3 % 997 if rnd.random() > 0.05 else None, " ".join(words)))
    return rows + ODD


def brute_groups(rows, n, num, den):
    ids, seen, sets = WordIds(), collections.defaultdict(list), []
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, text) in enumerate(rows):
        sets.append(shingle_hashes(ids.array(ascii_words(text)), n))
        common = collections.Counter()
        for e in sets[k].tolist():
            common.update(seen[e])
            seen[e].append(k)
        for j, c in common.items():
            if den * c >= num * (len(sets[k]) + len(sets[j]) - c):
                parent[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(sets[k]), least.get(find(k)) if len(sets[k]) else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_groups_match_brute_force(spark, n, num, den):
    rows = made_up()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("component", F.lit(1))
    got = collections.Counter(tuple(r) for r in ngram_join.similar_groups(df, n=n, num=num, den=den).collect())
    assert got == brute_groups(rows, n, num, den)


def test_groups_of_the_test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = collections.Counter(tuple(r) for r in ngram_join.op1_ngram_join(spark, sf).collect())
    assert got == brute_groups([tuple(r) for r in docs.collect()], 4, 85, 100)


def test_no_documents_no_groups(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = made_up(5, 12)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en"))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    groups = brute_groups(rows, 5, 80, 100)
    full = {c for (_, n, c) in groups if n and c is not None}
    left = [r["doc_id"] for r in kept.filter(F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " "))) > 0).collect()]
    assert set(left) - {None} == full and len([x for x in left if x is not None]) == len(full)
    assert kept.filter("text is null or trim(text) = '' or text = ' \n'").count() == 4


def near_sets(rnd, bands, tries):
    """Similar pairs of different sets."""
    for _ in range(tries):
        n = int(rnd.integers(7, 400))
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rnd.integers(0, n // 10 + 1)) :], rnd.integers(0, 2**63, int(rnd.integers(0, n // 10 + 1)), dtype=np.uint64)]))
        if bands.similar(len(np.intersect1d(a, b)), len(a), len(b)) and not np.array_equal(a, b):
            yield a, b


def tile_of(bands, sets, labels=None):
    nodes = np.arange(len(sets))
    return ngram_join.Tile(bands, nodes, np.array(list(map(len, sets))), [ngram_join.bitmap(e) for e in sets], nodes if labels is None else np.array(labels))


def test_bitmaps_never_refuse_a_similar_pair():
    bands = ngram_join.Bands(85, 100)
    for a, b in near_sets(np.random.default_rng(1), bands, 60):
        for family in (0, 1):
            assert set(bands.keys(a, family).tolist()) & set(bands.keys(b, family).tolist())
        assert tile_of(bands, [a, b]).forest() == [(0, 1)] == tile_of(bands, [a, b]).links([a, b])
        assert len(set(tile_of(bands, [a, b]).open_groups())) == 1 and set(tile_of(bands, [a, b], [5, 5]).open_groups()) == {-1}


@pytest.mark.parametrize("num", [80, 85])
def test_unrelated_sets_share_no_keys(num):
    rnd, bands, seen = np.random.default_rng(4), ngram_join.Bands(num, 100), collections.Counter()
    for _ in range(4000):
        seen.update(set(bands.keys(np.unique(rnd.integers(0, 2**63, int(rnd.integers(5, 80)), dtype=np.uint64))).tolist()))
    assert max(seen.values()) == 1


def test_sets_with_many_empty_parts_meet_their_partners():
    # All but one element in one half of the hash range: the first deal leaves many parts empty.
    rnd, bands = np.random.default_rng(5), ngram_join.Bands(80, 100)
    for _ in range(200):
        n = int(rnd.integers(20, 90))
        a = np.unique(np.concatenate([rnd.integers(0, 2**61, n, dtype=np.uint64), rnd.integers(2**61, 2**64, 1, dtype=np.uint64)]))
        b = np.delete(a, rnd.integers(0, n, n // 6))
        assert set(bands.keys(a).tolist()) & set(bands.keys(b).tolist())


def test_bits_that_fall_together_are_told_apart():
    # Sets that agree in the upper 48 bits of their hashes are not equal.
    a = np.arange(1, 41, dtype=np.uint64) << np.uint64(20)
    assert tile_of(ngram_join.Bands(85, 100), [a, a + np.uint64(1)]).links([a, a + np.uint64(1)]) == []


def brute_labels(texts, n, num, den):
    """Least position that links lead to, by word tuples; a matrix counts what two texts share."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in words]
    at = {e: k for k, e in enumerate(sorted(set().union(*sets)))}
    table = np.zeros((len(sets), len(at)), dtype=np.float32)
    for k, s in enumerate(sets):
        table[k, [at[e] for e in s]] = 1
    common, size = table @ table.T, table.sum(axis=1)
    linked = den * common >= num * (size[:, None] + size[None, :] - common)
    label = np.arange(len(sets))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("tile", [64, 1024])
def test_large_groups_of_copies(spark, monkeypatch, tile):
    rnd, vocab = random.Random(9), [f"v{k}" for k in range(5000)]
    near, rows = [rnd.choice(vocab) for _ in range(120)], []
    passage = [rnd.choice(vocab) for _ in range(60)]
    for k in range(900):
        words = list(near)
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append(" ".join(words))
    rows += [" ".join([*passage, *(rnd.choice(vocab) for _ in range(rnd.choice([8, 9, 10, 30])))]) for _ in range(300)]
    label = brute_labels(rows, 4, 85, 100)
    rows += [" ".join(near[::-1])] * 3000
    want = collections.Counter([*label.tolist(), *[1200] * 3000])
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "DIVIDED", 4 * tile)
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(4)
    made = []
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, *a, f=ngram_join._verify: (made.append(pairs.count()), f(pairs, *a))[1])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(df, n=4, num=85, den=100).collect()}
    assert collections.Counter(got.values()) == want and all(got[k] == v for k, v in enumerate(label.tolist()))
    assert made[0] < 40 * len(label)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {(r["node"], r["label"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in parent}


@pytest.mark.parametrize("head", [1000, 0])
def test_token_counts_are_the_library_s(spark, sf, head):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*ODD, (1, "a\n\n  b \n c  "), (2, " "), (3, "  "), (4, "\n"), (6, "<s> x</s>\r\n;\r ▁a ▁▁ b"), (7, "x" * 20000), *[(9, "y" * 300 + " z")] * 6, (None, "n"), (None, "n"), (8, "\x00 é　ﬁ 𝒳\t\t  \n\n")]
    rows += [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("token", F.lit(1)).withColumn("rid", F.lit("x"))
    got = collections.Counter(tuple(r) for r in token_counts.count_tokens(df, path, head=head).collect())
    few = token_counts.count_tokens(df, path, head=head, key_bits=2)  # rows that share a hash are counted by themselves
    assert collections.Counter(tuple(r) for r in few.collect()) == got
    assert got == collections.Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in rows)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_fingerprints(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    ties = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(ties, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = collections.Counter()
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        want[r["doc_id"], len(r["t"]), hashlib.sha256(fingerprints.edited(r["t"], n["t"]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprints(df.withColumn("bucket", F.lit(0)).repartition(3)).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    lexicon = fingerprints.lexicon_of(df)
    of = lambda t: fingerprints.fingerprint(np.unique(WordIds().array(ascii_words(t))), lexicon)
    expected = collections.Counter()
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        own, other, following = of(r["t"]), of(fingerprints.edited(r["t"], n["t"])), of(n["t"])
        expected[r["doc_id"], own.pack().hex(), other.pack().hex(), fingerprints.likeness(own, other), fingerprints.likeness(own, following)] += 1
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got) == expected
    assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 1000]) > 0.2 > np.mean([r["near_next"] for r in got if r["n_chars"] > 1000])
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
    single = fingerprints.fingerprints(spark.createDataFrame([(1, "abc def")], SCHEMA)).first()
    assert single["near_next"] == 1.0
    named = fingerprints.fingerprints(spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z")], "doc_id string, text string"))
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in named.collect()) == [("None", 1), ("a", 1), ("b", 1)]


def test_likeness_holds_for_any_sizes():
    # What a larger set shares with a small part of it shows at the larger one's level, whatever lies between.
    rnd, seen = np.random.default_rng(8), []
    for _ in range(200):
        a = np.unique(rnd.integers(0, 2**63, 2000, dtype=np.uint64))
        x, y = fingerprints.View.of(a, 40), fingerprints.View.of(rnd.choice(a, 60, replace=False), 40)
        level = fingerprints._level(x.n)
        own = {(int(w), int(t), int(v)) for w, t, v in zip(y.which, y.top, y.value, strict=True) if t >= level}
        assert own <= {(int(w), int(t), int(v)) for w, t, v in zip(x.which, x.top, x.value, strict=True)}
        seen.append(len(own))
        again, rest = fingerprints.View.unpack(x.pack())
        assert rest == b"" and again.pack() == x.pack()
    assert np.mean(seen) > 0.5


def test_edited_words_are_those_of_the_edited_text():
    rnd, ids, split = np.random.default_rng(6), WordIds(), []
    for _ in range(3000):
        text, following = ("".join(rnd.choice(list("aB0é \t\n\r\x0b\x0c\x1c\x85\u2003\U0001f600\ud800"), rnd.integers(0, 30))) for _ in range(2))
        words = ids.array(ascii_words(text))
        got = fingerprints.edited_words(text, words, following, ids)
        assert got.tolist() == ids.array(ascii_words(fingerprints.edited(text, following))).tolist(), (text, following)
    text, following = "one two three four five six seven eight nine", "a b c d e f g h i j k l m"
    words, ids.array = ids.array(ascii_words(text)), lambda w, of=ids.array: split.append(len(w)) or of(w)
    fingerprints.edited_words(text, words, following, ids)
    assert split == [7]  # the word at the seam, "sea", and six more; the first six are not looked up again


def test_equal_texts_have_equal_fingerprints():
    lexicon = np.arange(0, 2**40, 2**30, dtype=np.uint64)
    terms = np.unique(np.concatenate([lexicon[::3], np.array([5, 7], dtype=np.uint64)]))
    a, b = fingerprints.fingerprint(terms, lexicon), fingerprints.fingerprint(terms.copy(), lexicon)
    assert a.pack() == b.pack() == fingerprints.Fingerprint.unpack(a.pack()).pack() and fingerprints.likeness(a, b) == 1.0
    none = fingerprints.fingerprint(terms[:0], lexicon)
    assert fingerprints.likeness(none, none) == 1.0 and fingerprints.likeness(none, a) == 0.0

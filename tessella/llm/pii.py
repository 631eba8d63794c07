"""Personal data: fixed patterns, and further candidate spans chosen by boosted trees."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import add_columns, hash_sample

KINDS = ("email", "ip", "card", "phone")
#: Documents of which candidates are gathered for training, and candidates kept of them, at most. They are weakly labelled rows;
#: what is kept is what has the least hashes, so it is a fair sample of all kinds.
SAMPLE_DOCUMENTS = 3000
SAMPLE_CANDIDATES = 30_000
#: Candidates of one document, and base spans of it that are rewritten, at most.
PER_DOCUMENT, REWRITTEN = 40, 6
#: Wrong candidates beside a rewritten span.
BESIDE = 3
#: Least precision on the calibration part at which a kind's candidates are taken.
PRECISION = 0.98

# The base patterns. Possessive forms keep them linear and match the same text.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Candidate generators: wider than the base patterns. Labels of a domain are at most 127 by its format.
_AT = re.compile(r"[ ]*[(\[{]*@[)\]}]*[ ]*|[ (\[{]+(?:at|AT)[)\]} ]+")
_DOT = r"(?:\.|[ ]*[(\[{]\.[)\]}][ ]*|[ (\[{]+(?:dot|DOT)[)\]} ]+)"
_RIGHT = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{1,126}}")
_DOTS = re.compile(_DOT)
_DIGITS = re.compile(r"(?:\+|\(\+?)?[0-9](?:[0-9]|[ ().\-/_]{1,3}(?=[0-9(]))*")
_GROUP = re.compile(r"[0-9]+")
_HEX = re.compile(r"(?<![0-9A-Za-z:])[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:]+(?![0-9A-Za-z])")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[ ]*(?:[(\[{][ ]*(?:\.|dot|DOT)[ ]*[)\]}]|\.|[ ]dot[ ]|[ ]DOT[ ])[ ]*[0-9]{1,3}){3}(?![0-9])")
_AGAIN = re.compile(r"[ (\[{]*(?:@|at\b|AT\b)")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns, by kind and then start; offsets count code points."""
    found: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data; many are not."""
    found: set[tuple[str, int, int]] = set()
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        free, right = m.end(), _RIGHT.match(text, m.end())
        if start < m.start() and right:
            # Domains may run on into the next words; shorter ends are candidates as well.
            ends = [right.start() + k.start() for k in _DOTS.finditer(right[0])][1:]
            found.update(("email", start, e) for e in [*ends, right.end()] if not text[e - 1].isdigit())
    found.update(("ip", *m.span()) for m in _DEFANGED.finditer(text))
    for m in _DIGITS.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
        if len(groups) == 1 and groups[0][1] - groups[0][0] < 7:
            continue
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):  # 19 digits end it, so 19 groups at most
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                start, end = groups[i][0], groups[j][1]
                while start > m.start() and text[start - 1] in "+(":
                    start -= 1
                # A bracket that isn't closed within may stand around the span, not in it.
                for s in {start, start + (text[start] == "(" and ")" not in text[start:end])}:
                    if 13 <= n <= 19:
                        found.add(("card", s, end))
                    if 7 <= n <= 15:
                        found.add(("phone", s, end))
    found.update(("ip", *m.span()) for m in _HEX.finditer(text) if m[0].count(":") >= 3 and m.end() - m.start() >= 8)
    return sorted(found)


_WORDS = (
    re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I),
    re.compile(r"phone|tel|call|mobile|fax|anruf|appel", re.I),
    re.compile(r"card|visa|credit|karte|carte|tarjeta|payment", re.I),
    re.compile(r"\bip\b|address|host|server|login|client", re.I),
    re.compile(r"token|secret|key|hash|sha|md5|version|license|isbn|order|invoice|ref|id\b", re.I),
)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits, groups = _digits(s), _GROUP.findall(s)
    sizes = [len(g) for g in groups] or [0]
    seps = [c for c in s if not c.isalnum()]
    prev, nxt = before[-1:], after[:1]
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        len(seps), len(set(seps)), s.count("."), s.count("-"), s.count(" "), s.count("@"), s.count(":"),
        float(s[:1] in "+("), float(s[:1] == "0"), float(len(digits) > 1 and luhn(digits)), float(len(groups) == 4 and all(map(_small, groups))),
        sum(c.isalpha() for c in s), float(bool(re.search(r"\bdot\b|\bat\b", s, re.I))), len(re.split(r"[.\s)\]}]+", s)[-1]),
        float(bool(prev) and prev.isalnum()), float(bool(nxt) and nxt.isalnum()), float(prev in tuple("+(-./@_")), float(nxt in tuple("-./@_")),
        float(bool(_AGAIN.match(after))), s.count("["), float(len([g for g in s.split(":") if g]) >= 4 and all(len(g) <= 4 for g in s.split(":"))), float(any(c in "abcdefABCDEF" for c in s)),
        float(after[:2].strip()[:1].isdigit()), float(before[-2:].strip()[-1:].isdigit()), float(prev in ('"', "'", "=")),
        s.count("(") - s.count(")"), float(nxt == "." and not after[1:2].isalnum()),
        float(after.lstrip(" ()./-_")[:1].isdigit()), float(before.rstrip(" ()./-_")[-1:].isdigit()),
        *[float(bool(w.search(before))) for w in _WORDS],
    ]


def _variants(kind: str, s: str) -> list[tuple[str, int]]:
    """Other ways to write a confirmed span (label 1), and things that look like it (label 0)."""
    d = _digits(s)
    if kind == "email":
        # Names and domains of other shapes than the text's own, so that the trees don't learn one source's habits.
        own, _, given = s.partition("@")
        plain, label, turn = "".join(c for c in own if c.isalpha()) or "info", given.split(".")[-2], _order(s)
        name = (own, plain, f"{plain[:1]}.{plain}", f"{plain}_{len(s)}", plain[:4])[turn % 5]
        domain = (given, f"{label}.org", f"{plain}.de", f"{label}.co.uk", f"mail.{plain}.fr", f"www-{label}.info")[turn // 5 % 6]
        return [
            (f"{name} at {domain.replace('.', ' dot ')}", 1), (f"{name} [at] {domain.replace('.', ' [dot] ')}", 1), (f"{name}(at){domain}", 1),
            (f"{name} at {domain}", 1), (f"{name} (at) {domain.replace('.', ' (dot) ')}", 1), (f"{name}[@]{domain}", 1), (f"{name} @ {domain.replace('.', ' . ')}", 0),
            (f"{name}@{domain.replace('.', '[.]')}", 1), (f"{name} @ {domain}", 1), (f"{name} AT {domain.replace('.', ' DOT ')}", 1),
            (f"{name} at the", 0), (f"{name}@", 0),
        ]
    if kind == "ip":
        a, b, c, e = s.split(".")
        w, x, y, z = (f"{int(p) * 257 + 4096:x}" for p in (a, b, c, e))
        return [
            (f"{a}[.]{b}[.]{c}[.]{e}", 1), (f"{a}(.){b}(.){c}(.){e}", 1), (f"{a} dot {b} dot {c} dot {e}", 1), (f"{a}[dot]{b}[dot]{c}[dot]{e}", 1), (f"{a}.{b}.{c}[.]{e}", 1), (f"{a} . {b} . {c} . {e}", 1),
            (f"2001:db8::{w}:{x}:{y}", 1), (f"fe80::{w}:{x}:{y}:{z}", 1), (f"fe80::{y}:{z}", 1), (f"2001:db8:{w}:{x}:{y}:{z}:{w}:1", 1), (f"2001:DB8:0:0:{w}:{x}:{y}:{z}".upper(), 1),
            (f"{int(a) % 24:02}:{int(b) % 60:02}:{int(c) % 60:02}:{int(e) % 60:02}", 0), (f"{int(a):02x}:{int(b):02x}:{int(c):02x}:{int(e):02x}:{int(a):02x}:{int(b):02x}", 0),
            (f"{a}.{b}", 0), (f"{a}.{b}.{c}", 0), (f"{a}-{b}-{c}-{e}", 0), (f"{int(a) + 300}.{b}.{c}.{e}", 0), (f"{int(a) + 300}[.]{b}[.]{c}[.]{e}", 0), (f"{a[:1]} . {b} . {int(c) + 300} . {e}", 0),
        ]
    if kind == "card":
        wrong = d[:-1] + str((int(d[-1]) + 5) % 10)
        quads = lambda x, sep: sep.join(x[k : k + 4] for k in range(0, len(x), 4))
        pairs = lambda x, sep: sep.join(x[k : k + 2] for k in range(0, len(x), 2))
        # Dotted pairs or digits are not among them: the base pattern of addresses takes those, and base spans stay.
        return [
            (quads(d, " "), 1), (quads(d, "-"), 1), (quads(d, "."), 1), (quads(d, "  "), 1), (pairs(d, "  "), 1), (pairs(d, "/"), 1), ("  ".join(d), 1),
            (wrong, 0), (quads(wrong, " "), 0), (quads(wrong, "."), 0), (pairs(wrong, "  "), 0), (pairs(wrong, "/"), 0), ("  ".join(wrong), 0),
        ]
    local = d[-10:]
    return [
        (f"({local[:3]}) {local[3:6]}-{local[6:]}", 1), (f"{local[:3]}-{local[3:6]}-{local[6:]}", 1), (f"{local[:3]}.{local[3:6]}.{local[6:]}", 1),
        (f"00{d[:-10] or '1'} {local[:3]} {local[3:6]} {local[6:]}", 1), (f"+{d[:-10] or '1'}/{local[:3]}/{local[3:6]}/{local[6:]}", 1),
        (f"{local[:3]} {local[3:6]} {local[6:]}", 1), (f"0{local[1:3]}/{local[3:]}", 1), (f"0{local[1]} {local[2:4]} {local[4:6]} {local[6:8]} {local[8:]}", 1), (f"00{d[:-10] or '49'}-{local[:2]}-{local[2:]}", 1), (f"0{local[1:4]} {local[4:]}", 1),
        (f"{local[:2]} {local[2:4]} {local[4:6]} {local[6:8]}", 0), (f"{local[:3]} {local[3:6]}", 0), (f"{local[:3]}/{local[3:6]}", 0),
        (" ".join(local), 1), ("-".join(local), 1), ("/".join(local), 1), (f"0 {' '.join(local[1:])}", 1), (" ".join(local[:7]), 0), ("-".join(local[:7]), 0), (local, 0), (local[:7], 0), (f"{local[:4]}-{local[4:6]}-{local[6:8]}", 0), (f"{local[:4]}/{local[4:8]}", 0), (f"{local[:2]}.{local[2:4]}.{local[4:8]}", 0),
        (f"978-{local[0]}-{local[1:3]}-{local[3:9]}-{local[9:]}", 0), (f"20{local[:2]}-20{local[2:4]}", 0), (f"20{local[:2]}-0{local[2]}-1{local[3]} 1{local[4]}", 0),
    ]


#: What may stand around a rewritten span, beside the words of its own text (None).
_FRAMES = ((None, None), (None, None), ("(", ")"), (None, ". "), (None, ", "), ("\n", "\n"), ('"', '"'))
#: What may stand before a rewritten address: other words that could be taken for its beginning.
_LEADS = ("", "", "reach me at ", "contact me at ", "write to ")


def _order(text: str, *of) -> int:
    return xxhash.xxh3_64_intdigest(f"{len(text)}:{of}".encode("utf-8", "replace"))


def training_rows(text: str, most: int = PER_DOCUMENT) -> list[tuple[list[float], int]]:
    """Features and weak labels: base spans and rewritings of them are right, other candidates wrong."""
    base = base_spans(text)
    right, rows = set(base), []
    # Where a pattern ran on too far to be one span, what is right within it isn't known.
    unsure = [m.span() for m in (*_PHONE.finditer(text), *_CARD.finditer(text)) if len(_digits(m[0])) > 15 and not any(s < m.end() and m.start() < e for _, s, e in base)]
    for kind, start, end in sorted(candidates(text), key=lambda c: _order(text, *c))[:most]:
        mine = (kind, start, end) in right
        if mine or not (any(k == kind and s < end and start < e for k, s, e in base) or any(s < end and start < e for s, e in unsure)):
            rows.append((features(text, kind, start, end), int(mine)))
    for kind, start, end in sorted(base, key=lambda c: _order(text, *c))[:REWRITTEN]:
        before, after = text[max(0, start - 30) : start], text[end : end + 30]
        for at, (s, label) in enumerate(_variants(kind, text[start:end])):
            lead = _LEADS[(start + at) % len(_LEADS)] if kind == "email" else ""
            left, right_of = _FRAMES[_order(text, start, at) % len(_FRAMES)]
            lead = lead if left is None else f" {left}"
            other, lo = before + lead + s + (right_of or "") + after, len(before) + len(lead)
            hi = lo + len(s)
            near = [(a, b) for k, a, b in candidates(other) if k == kind and a < hi and lo - len(lead) < b]
            rows += [(features(other, kind, a, b), label) for a, b in near if (a, b) == (lo, hi)]
            # Of its parts and what reaches beyond it, a few stand for all: else they would outweigh the rest of the sample.
            wrong = sorted((c for c in near if c != (lo, hi)), key=lambda c: _order(other, *c))[:BESIDE]
            rows += [(features(other, kind, a, b), 0) for a, b in wrong]
    return rows


@dataclass
class Model:
    trees: boosting.Trees
    slope: float
    shift: float
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -30, 30)))


def train(docs: DataFrame, text: str = "text") -> Model | None:
    """Boosted trees on candidates of at most SAMPLE_DOCUMENTS documents; None where they hold too few."""
    sample = hash_sample(docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]")), F.col("text"), SAMPLE_DOCUMENTS)
    rows = sample.dropDuplicates().mapInArrow(_train_batches, "x array<float>, y int, text bigint").orderBy(F.xxhash64("x", "y"), "text").limit(SAMPLE_CANDIDATES).collect()
    if len(rows) < 50 or len({r["y"] for r in rows}) < 2:
        return None
    x, y = np.array([r["x"] for r in rows], dtype=float), np.array([r["y"] for r in rows], dtype=float)
    held = np.array([r["text"] % 3 == 0 for r in rows])  # by document: rewritings of a span are all on one side
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    trees = boosting.fit(x[~held], y[~held], n_trees=100, depth=4, rate=0.3)
    slope, shift = boosting.platt(trees.margin(x[held]), y[held])
    model = Model(trees, slope, shift, {})
    p = model.scores(x[held])
    for k, kind in enumerate(KINDS):
        mine = x[held][:, 0] == k
        order = np.argsort(-p[mine])
        precision = np.cumsum(y[held][mine][order]) / np.arange(1, len(order) + 1) if len(order) else np.array([])
        good = np.flatnonzero(precision >= PRECISION)
        model.thresholds[kind] = max(0.5, float(p[mine][order][good[-1]])) if len(good) and good[-1] >= 19 else 2.0
    return model


def _train_batches(batches):
    for batch in batches:
        rows = [(*r, xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1) for t in batch.column(0).to_pylist() for r in training_rows(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["x", "y", "text"])


def all_spans(text: str, model: Model | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those and candidates over their kind's threshold that overlap none before them."""
    base = base_spans(text)
    if model is None:
        return base, base
    wide = [c for c in candidates(text) if not any(s < c[2] and c[1] < e for _, s, e in base)]
    if not wide:
        return base, base
    # A long row of single digits has many candidates; their features are held for a block at a time.
    p = np.concatenate([model.scores(np.array([features(text, *c) for c in wide[k : k + 10_000]], dtype=float)) for k in range(0, len(wide), 10_000)])
    taken: list[tuple[str, int, int]] = []
    for k in sorted(range(len(wide)), key=lambda k: (-p[k], -(wide[k][2] - wide[k][1]), wide[k])):
        kind, start, end = wide[k]
        if p[k] >= model.thresholds[kind] and not any(s < end and start < e for _, s, e in taken):
            taken.append(wide[k])
    return base, sorted(base + taken, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (kind, start, end), by kind and then start.

    Null and empty texts have no spans. Every row is judged alone, so repeated rows give repeated
    results. Columns named base_spans or spans are replaced.
    """

    def make():
        as_dicts = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

        def each(texts):
            found = [all_spans(t, model) if t else ([], []) for t in texts]
            return [[as_dicts(b) for b, _ in found], [as_dicts(a) for _, a in found]]

        return each

    return add_columns(docs, [text], make, {"base_spans": (_SPANS, _ARROW_SPANS), "spans": (_SPANS, _ARROW_SPANS)})


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans, all that either covers goes.

    Null and empty texts stay. Every row is redacted alone and whole, repeated rows alike; other columns keep their
    names, places and values, but one named ``__pii_raw``. An empty table gives no rows.
    """

    def clean(t: str) -> str:
        out, at = [], 0
        for kind, start, end in sorted(all_spans(t, model)[1], key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [t[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, t[at:]])

    def make():
        return lambda texts: [[clean(t) if t else t for t in texts]]

    columns = docs.columns
    done = add_columns(docs.withColumnRenamed(text, "__pii_raw"), ["__pii_raw"], make, {text: ("string", pa.string())})
    return done.select(*columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, train(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))

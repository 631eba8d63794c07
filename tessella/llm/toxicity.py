"""Toxicity: disguised words restored by Viterbi decoding under a character model, then scored."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut, hash_sample, held_out, stage

#: Labelled documents to learn words and weights from, at most; words in the lexicon, at most.
SAMPLE = 20_000
LEXICON = 400
#: Lengths of stems, in bytes.
STEMS = (5, 6, 7)
#: Texts of more distinct words count for less in the choice of the lexicon, in thousandths.
LEARN_WORDS = 1000
UNIT = 1000
#: Decodings of a disguised word that are looked up.
BEST = 12

# What a sign may stand for.
CHANNEL = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "à": "a", "á": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ò": "o", "ó": "o", "ô": "o", "ö": "o", "õ": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ñ": "n", "ç": "c",
}
_SWAP, _WILD, _KEEP_REPEAT, _DROP_REPEAT = 0.7, 2.5, 0.4, 0.5
_WIDE = {0xFF01 + k: 0x21 + k for k in range(94)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
#: What the decoder reads, as a character class; the triggers are all of it but plain letters.
_CODED = "".join(map(re.escape, CHANNEL))
_SIGN = f"[a-z{_CODED}]"
_TRIGGER = re.compile(f"[*{_CODED}{''.join(map(chr, _WIDE))}]")
_TRIPLE = re.compile(r"([a-z])\1\1")
_SPACED = re.compile(rf"(?<![^\W_]){_SIGN}(?:[ .\-_*]{{1,2}}{_SIGN}(?![^\W_])){{3,}}")
_PIECES = re.compile(rf"(?<![^\W_]){_SIGN}{{1,3}}(?:[.\-_*]{{1,2}}{_SIGN}{{1,3}}){{2,}}(?![^\W_])")
#: What stands between signs that the decoder can't read; letters without a reading don't part words.
_RUN = re.compile(rf"(?:[*{_CODED}]|[^\W_])+")
#: Figures with signs before and after them, and stars: not words.
_NUMBER = re.compile(r"[+$€£#(<*]*[0-9*]*[!|*]*")
_SINGLE = {ord(k): v for k, v in CHANNEL.items() if len(v) == 1}
_PLAIN = re.compile("[a-z]+")
_DOUBLE = re.compile(r"(.)\1")
_REPEATS = re.compile(r"([^*])\1{3,}")
_BETWEEN = re.compile(r"[ .\-_*]+")
#: Longest word of the lexicon, in bytes. With each letter up to three times it fits into the overlap of two pieces.
LONGEST = 40
PIECE, STEP = 4 * LONGEST, LONGEST
_EDGE = " \t\n\r.,;:!?\"'()[]{}*#%&$<>=-_/\\|+~^`"
#: Bytes that part words: every ASCII character but letters.
_TO_SPACE = bytes(k if 97 <= k < 123 or k >= 128 else k + 32 if 65 <= k < 91 else 32 for k in range(256))
_CODES = np.array([k - 96 if 97 <= k < 123 else k - 64 if 65 <= k < 91 else 0 for k in range(256)], dtype=np.int64)
#: Bits of a code point: separator, separator but space, sign, letter or digit, sign of _WIDE.
_KINDS = np.zeros(0x10000, dtype=np.uint8)
_KINDS[[ord(c) for c in " .-_*"]] |= 1
_KINDS[[ord(c) for c in ".-_*"]] |= 2
_KINDS[[ord(c) for c in [*"abcdefghijklmnopqrstuvwxyz", *CHANNEL]]] |= 4
_KINDS[[k for k in range(0x10000) if chr(k).isalnum()]] |= 8
_KINDS[list(_WIDE)] |= 16


def _kinds(text: str) -> np.ndarray:
    """The bits of each code point, with three zeros at either end; none beyond the basic plane, which lets more through."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.pad(_KINDS[np.where(points < 0x10000, points, 0)], 3)


def _has_spaced(kinds: np.ndarray) -> bool:
    """Whether _SPACED may match: four signs, each one or two separators after the one before."""
    sep, sign, word = (kinds & 1) > 0, (kinds & 4) > 0, (kinds & 8) > 0
    reached = sign[3:-3] & ~word[2:-4]
    ends = sign[3:-3] & ~word[4:-2] & sep[2:-4]
    for _ in range(3):
        before = np.pad(reached, (3, 0))
        reached = ends & (before[1:-2] | before[:-3] & sep[1:-5])
        if not reached.any():
            return False
    return True


def _has_pieces(kinds: np.ndarray) -> bool:
    """Whether _PIECES may match: two runs of one or two separators with one to three signs between them."""
    sep, sign = (kinds & 2) > 0, (kinds & 4) > 0
    at = np.flatnonzero(sep[3:-3] & sign[2:-4] & (sign[4:-2] | sep[4:-2] & sign[5:-1]))
    return bool((np.diff(at) <= 5).any())


@dataclass
class CharModel:
    """log P(c | a, b) over the letters a-z and 0 for anything else, from trigram counts."""

    logp: np.ndarray  # (27, 27, 27)
    _flat: list[float] | None = field(default=None, repr=False, compare=False)  # the same for single look-ups

    @staticmethod
    def of(counts: dict[int, int]) -> CharModel:
        c = np.zeros(27**3)
        for code, n in counts.items():
            c[code] = n
        c = c.reshape(27, 27, 27)
        lower = (c.sum(axis=0) + 0.5) / (c.sum(axis=0).sum(axis=1, keepdims=True) + 13.5)
        return CharModel(np.log((c + 20 * lower) / (c.sum(axis=2, keepdims=True) + 20)))

    def decode(self, signs: str, best: int = BEST) -> list[str]:
        """Likeliest letter strings behind ``signs``, best first; signs without a reading end the attempt."""
        plain = signs.translate(_SINGLE)
        if _PLAIN.fullmatch(plain) and not _DOUBLE.search(signs):
            return [plain]  # one reading a sign and no repeats: there is nothing to choose
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        if self._flat is None:
            self._flat = self.logp.ravel().tolist()
        flat, before = self._flat, ""
        for c in signs:
            if "a" <= c <= "z":
                options = [(c, 0.0)]
            elif c == "*":
                options = [(v, _WILD) for v in "aeiou"]
            elif c in CHANNEL:
                options = [(v, _SWAP) for v in CHANNEL[c]]
            else:
                return []
            repeated, reached = c == before and c != "*", {}
            for (a, b), paths in states.items():
                for v, cost in options:
                    k = ord(v) - 96
                    gain = flat[a * 729 + b * 27 + k] - cost - (_KEEP_REPEAT if repeated else 0)
                    reached.setdefault((b, k), []).extend([(s + gain, t + v) for s, t in paths])
                if repeated:
                    reached.setdefault((a, b), []).extend([(s - _DROP_REPEAT, t) for s, t in paths])
            states = {k: sorted(set(v), reverse=True)[:best] if len(v) > 1 else v for k, v in reached.items()}
            before = c
        ends = sorted(((s + flat[a * 729 + b * 27], t) for (a, b), paths in states.items() for s, t in paths), reverse=True)
        return list(dict.fromkeys(t for _, t in ends))[:best]


def trigram_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Character trigram counts over every whole text: 27^3 of them at most."""

    def run(batches):
        total = np.zeros(27**3, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    c = _CODES[np.frombuffer(f" {t} ".encode("utf-8", "replace"), dtype=np.uint8)]
                    total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], names=["code", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in rows.collect()}


def plain_words(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "replace").translate(_TO_SPACE).split())


_REPEATED = re.compile(rb"(.)\1")
_RUN_OF_ONE = re.compile(rb"(.)\1+")


def _squeeze(word: bytes) -> bytes:
    return _RUN_OF_ONE.sub(rb"\1", word)


def with_stems(words: set[bytes]) -> set[bytes]:
    """The words, and their first bytes with a star: insults are inflected and compounded."""
    return words | {w[:k] + b"*" for w in words for k in STEMS if len(w) > k}


class Restorer:
    """Finds disguised words and decodes them; keeps what it has decoded, up to a bound.

    With ``wanted``, the words and stems (with a star) that matter, words of which no reading may be one are not decoded.
    """

    def __init__(self, model: CharModel, lexicon: frozenset[str] = frozenset(), wanted: frozenset[bytes] | None = None):
        self.model, self.lexicon, self.seen, self.tokens, self.plain = model, lexicon, {}, {}, set()
        squeezed = [] if wanted is None else [_squeeze(w.removesuffix(b"*")).decode("latin-1") for w in wanted]
        self.whole = None if wanted is None else frozenset(squeezed)
        self.starts = frozenset(w[:k] for w in squeezed for k in range(len(w) + 1))

    def may_matter(self, signs: str) -> bool:
        """Whether some reading, each run of a letter taken once, begins with a wanted word or stem."""
        if self.whole is None or "" in self.whole:
            return True
        begun = {""}
        for c in signs:
            options = "aeiou" if c == "*" else CHANNEL.get(c, c)
            begun = {p if p[-1:] == v else p + v for p in begun for v in options} & self.starts
            if not begun:
                return False
            if not begun.isdisjoint(self.whole):
                return True
        return False

    def decode(self, signs: str) -> list[str]:
        """The lexicon's words among the best decodings, or else the best one; nothing for plain words."""
        if signs not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.model.decode(signs)
            known = [w for w in found if w in self.lexicon]
            self.seen[signs] = known[:1] or found[:1]
        return self.seen[signs]

    def restored(self, text: str) -> list[str]:
        """Words behind leetspeak, look-alike signs, repeated letters and letters set apart."""
        lower = text.lower()
        out = []
        for token in set(lower.split()) - self.plain:
            found = self.tokens.get(token)
            if found is None:
                if not _TRIGGER.search(token) and not _TRIPLE.search(token):
                    if len(self.plain) > 100_000:
                        self.plain.clear()
                    self.plain.add(token)
                    continue
                if len(self.tokens) > 100_000:
                    self.tokens.clear()
                found = self.tokens[token] = self._token(token)
            out += found
        kinds = _kinds(lower)
        if (kinds & 16).any():
            lower = lower.translate(_WIDE)
            kinds = _kinds(lower)
        if _has_spaced(kinds):
            out += self._apart(_SPACED, lower)
        if _has_pieces(kinds):
            out += self._apart(_PIECES, lower)
        return out

    def _token(self, token: str) -> list[str]:
        """Words behind what stands between two spaces, in any length."""
        out = []
        for run in _RUN.findall(token.translate(_WIDE)):
            # A sign at the edge may be a letter ("$cum") or just a sign; both readings are tried.
            for signs in dict.fromkeys((run.strip(_EDGE), run)):
                signs = _REPEATS.sub(r"\1\1\1", signs)
                if len(signs) >= 3 and not _NUMBER.fullmatch(signs):
                    if len(signs) > LONGEST:
                        out += self._within(signs)
                    elif self.may_matter(signs):
                        out += self.decode(signs)
        return out

    def _within(self, signs: str) -> list[str]:
        """Words somewhere in ``signs``; long ones are decoded in overlapping pieces."""
        out = []
        for at in range(0, max(1, len(signs) - PIECE + STEP), STEP):
            for word in self.decode(signs[at : at + PIECE]):
                out += [word, *[w for w in self.lexicon if len(w) > 3 and w in word]]
        return out

    def _apart(self, pattern: re.Pattern, lower: str) -> list[str]:
        """Words whose letters stand apart, also several in a row."""
        out = []
        for m in pattern.finditer(lower):
            signs = _REPEATS.sub(r"\1\1\1", _BETWEEN.sub("", m[0]))
            if len(signs) >= 3:
                out += self._within(signs)
        return out


@dataclass
class Scorer:
    chars: CharModel
    words: dict[bytes, int]  # word, or stem with a star -> feature
    weights: np.ndarray
    bias: float
    _squeezed: dict[bytes, bytes] | None = field(default=None, repr=False, compare=False)
    #: Words met, without and with features, up to a bound.
    _nothing: set[bytes] = field(default_factory=set, repr=False, compare=False)
    _known: dict[bytes, set[int]] = field(default_factory=dict, repr=False, compare=False)

    def restorer(self) -> Restorer:
        return Restorer(self.chars, frozenset(w.decode("utf-8", "replace") for w in self.words if not w.endswith(b"*")), frozenset(self.words))

    def hits(self, restorer: Restorer, text: str) -> list[int]:
        found = plain_words(text) | {w.encode() for w in restorer.restored(text)}
        hits: set[int] = set()
        for w in found - self._nothing:
            own = self._known.get(w)
            if own is None:
                own = self._of(w)
                kept = self._known if own else self._nothing
                if len(kept) > 100_000:
                    kept.clear()
                if not own:
                    kept.add(w)
                    continue
                kept[w] = own
            hits |= own
        return sorted(hits)

    def _of(self, word: bytes) -> set[int]:
        """The features of one word, by itself and by its stems."""
        if self._squeezed is None:
            plain = (w for w in self.words if not w.endswith(b"*"))
            self._squeezed = {_squeeze(w): w for w in plain}
        found = {word}
        # Letters that are only doubled are no trigger: too many words have one. A word with two more repeats than the lexicon's is it.
        if _REPEATED.search(word):
            meant = self._squeezed.get(_squeeze(word))
            if meant is not None and len(word) >= len(meant) + 2:
                found.add(meant)
        return {self.words[w] for w in with_stems(found) & self.words.keys()}

    def score(self, hits: list[int]) -> float:
        total = self.bias + self.weights[hits].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _logistic(rows: list[list[int]], y: np.ndarray, start: np.ndarray, rounds: int = 300, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of present words, drawn towards ``start``, and the bias."""
    ids = np.concatenate([np.array(r, dtype=np.int64) for r in rows]) if any(rows) else np.array([], dtype=np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = start.copy(), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, gb = np.full(len(w), 1e-6), 1e-6
    for _ in range(rounds):
        margin = b + np.bincount(of, w[ids], len(rows))
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        d = np.bincount(ids, err[of], len(w)) + l2 * (w - start)
        gw += d**2
        gb += err.sum() ** 2
        w -= rate * d / np.sqrt(gw)
        b -= rate * err.sum() / np.sqrt(gb)
    return w, b


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer | None:
    """Character model from all of ``docs``; words and weights from at most SAMPLE labelled ones.

    None if only one label is there. Ids with several labels count as toxic if half of them say so; null
    ids and labels are left out.
    """
    chars = CharModel.of(trigram_counts(docs, text))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).dropna().groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = F.broadcast(hash_sample(known, F.col("id"), SAMPLE))  # SAMPLE rows at most
    # Of equal texts one is enough: copies would pass for so many witnesses of their words. Like ids, they go by their mean label.
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).dropna().join(known, "id").groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    picked = stage(picked.select("y", "text"))  # read three times below

    def words(batches):
        restorer = Restorer(chars)
        for b in batches:
            seen = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = plain_words(t) | {x.encode() for x in restorer.restored(t)}
                # A very long text holds so many words that its label says little about any of them.
                weight = max(1, UNIT * LEARN_WORDS // max(len(found), LEARN_WORDS))
                for w in with_stems(found):
                    if len(w) <= LONGEST:
                        seen[y][w] += weight
                seen[y][b""] += weight  # no word: the sum over all texts
            clean, toxic = seen
            # Latin-1 carries any bytes through a string column. Words of clean texts alone can't be chosen,
            # but may be of toxic ones in another batch.
            both = sorted(clean.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in both], pa.string()), pa.array([toxic[w] for w in both], pa.int64()), pa.array([clean[w] for w in both], pa.int64())], names=["word", "t", "c"])

    if picked.select("y").distinct().count() < 2:
        return None
    seen = picked.mapInArrow(words, "word string, t bigint, c bigint").groupBy("word").agg((F.sum("t") / UNIT).alias("t"), (F.sum("c") / UNIT).alias("c"))
    seen = cut(seen)
    total = seen.filter("word = ''").first()
    sizes = total["c"], total["t"]
    odds = lambda n, total: F.log((F.col(n) + 0.5) / (F.lit(total) - F.col(n) + 0.5))
    ratio = odds("t", sizes[1]) - odds("c", sizes[0])
    # The ratio less three standard errors: rare words must be all the clearer.
    sure = (ratio - 3 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))).alias("sure")
    gain = F.log((F.col("t") + 0.5) / (sizes[1] + 1) / ((F.col("c") + 0.5) / (sizes[0] + 1))).alias("gain")
    rows = seen.filter("word <> '' and t >= 5").select("word", sure, gain).filter("sure > 0.5").orderBy(F.desc("sure"), "word").limit(LEXICON).collect()
    rows = sorted(rows, key=lambda r: r["word"])
    lexicon = {r["word"].encode("latin-1"): k for k, r in enumerate(rows)}
    scorer = Scorer(chars, lexicon, np.array([0.7 * r["gain"] for r in rows]), 0.0)

    def hits(batches):
        restorer = scorer.restorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.hits(restorer, t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["y", "hits"])

    table = picked.mapInArrow(hits, "y int, hits array<int>").toArrow()
    rows = sorted(zip(table.column("hits").to_pylist(), table.column("y").to_pylist(), strict=True))
    scorer.weights, scorer.bias = _logistic([r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), scorer.weights)
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of the toxic label. Null and empty texts get that of no word found; without a scorer all get 0.

    Every row is scored alone and whole, so repeated rows have equal scores; a very long text costs memory for itself. A
    column named score is replaced, others pass through; an empty table gives no rows.
    """

    def make():
        restorer = scorer.restorer() if scorer else None
        return lambda texts: [[0.0 if scorer is None else scorer.score(scorer.hits(restorer, t) if t else []) for t in texts]]

    return add_columns(docs, [text], make, {"score": ("double", pa.float64())})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = train(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)))
    scored = score_toxicity(docs, scorer)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

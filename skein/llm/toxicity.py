"""Toxicity: disguised words are decoded as through a noisy channel, then the restored text is scored.

A suspicious stretch (letters mixed with look-alike digits and signs, single letters with runs of separators between them, a
letter twice or more) is a lattice: each sign may stand for itself, for a look-alike letter, or for nothing
(separators, repeats). Viterbi's algorithm picks the likeliest letters under a trigram model of characters counted over
all words of all documents. A stretch with look-alikes stays undecoded where signs drawn evenly explain it better (keys,
numbers), whatever its length. Words of the text and of the restored stretches are then scored: a word's evidence is that of the
word or of its beginning (PREFIXES letters), whichever tells most, and two numbers of each text, the greatest evidence
and the logarithm of the sum, go through a logistic model.

The weights of evidence and the logistic model are fitted on at most MAX_TRAIN labelled rows (those with the least hash of
the key); the trigram model has no such bound. Defined results: null and empty texts have no evidence and get the lowest
score; without labels of both classes every score is 0; of decodings that are equally likely the first found counts;
repeated rows keep their own result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import held_out, python_batches

MAX_TRAIN = 20_000
#: A feature counts if at least this share of the labelled texts that have it are toxic.
MIN_SHARE = 0.6
PREFIXES = (4, 5, 6, 7)
#: Distinct words, stretches and trigrams that a worker keeps the results of.
CACHE = 300_000
#: Distinct trigrams that a worker counts before it hands them on.
FLUSH_GRAMS = 1_000_000
#: Look-alikes of letters, and what the channel costs (log probabilities).
LOOK = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "*": "",
}
SEPARATORS = " .-_*~',/\t\n\r"
#: Look-alikes that are plain punctuation before and after a word.
BEFORE, AFTER = "(*", "!(*"
ITSELF, AS_LETTER, DROPPED, REPEAT, TWICE, UNREADABLE = (math.log(p) for p in (0.9, 0.3, 0.01, 0.5, 0.01, 1e-6))
#: A sign left as it is, one of a byte's values: disguised words cost less, keys and numbers more.
AS_IS = math.log(1 / 256)
_WORD = re.compile(r"[^\W\d_]+")
_LEET = "0-9@$!|+€£¢(*"
_SIGN, _GAP = r"(?:[^\W_]|[@$!|+])", f"[{re.escape(SEPARATORS)}]++"
#: s p a c e d letters, always by the same run of separators; and by any. A text may hold both: a i.d.i.o.t
_SPACED = re.compile(rf"(?<![^\W_]){_SIGN}({_GAP}){_SIGN}(?:\1{_SIGN})+(?![^\W_])")
_LOOSE = re.compile(rf"(?<![^\W_]){_SIGN}(?:{_GAP}{_SIGN}){{2,}}(?![^\W_])")
#: A stretch of letters and look-alikes, both of them (letters are looked for later).
_MIXED = re.compile(rf"(?<![\w{_LEET}])[^\W\d]*+[{_LEET}][\w{_LEET}]*+")
_DOUBLE, _RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1+")


@dataclass
class Letters:
    """A trigram model of the characters of words, with backoff to bigrams and single characters."""

    counts: dict[str, int] = field(default_factory=dict)
    size: int = 40

    @classmethod
    def learn(cls, words: dict[str, int]) -> Letters:
        c: Counter = Counter()
        for w, n in words.items():
            p = f"^^{w}$"
            for i in range(2, len(p)):
                for k in (0, 1, 2):
                    c[p[i - k : i + 1]] += n
                    c[p[i - k : i] + "\0"] += n  # what a context was seen in all
        return cls(dict(c))

    def plus(self, words: dict[str, int]) -> Letters:
        """A model that has seen these words too."""
        return Letters(dict(Counter(self.counts) + Counter(Letters.learn(words).counts)), self.size)

    @property
    def total(self) -> int:
        """How many words were seen."""
        return self.counts.get("^^\0", 0)

    @cached_property
    def logs(self) -> Logs:
        """What log gives for each context of two characters and letter; one for all tasks of a worker."""
        return Logs(self)

    def log(self, context: str, letter: str) -> float:
        p = 1 / (self.size * 4)
        for k in (0, 1, 2):
            part = context[2 - k :]
            n = self.counts.get(part + "\0", 0)
            p = (self.counts.get(part + letter, 0) + 4 * p) / (n + 4)
        return math.log(p)


class Logs(dict):
    """Trigram to its log probability; what was counted before is kept."""

    def __init__(self, letters: Letters):
        super().__init__()
        self.letters = letters

    def __missing__(self, gram: str) -> float:
        out = self.letters.log(gram[:-1], gram[-1])
        if len(self) < CACHE:
            self[gram] = out
        return out


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each sign what it may stand for and the log probability; '' is nothing."""
    out = []
    before, after = len(stretch) - len(stretch.lstrip(BEFORE)), len(stretch.rstrip(AFTER))
    for i, c in enumerate(stretch):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, ITSELF))
            if i and stretch[i - 1] == c:
                options.append(("", REPEAT if c * 3 in stretch[max(0, i - 2) : i + 3] else TWICE))
        elif c in SEPARATORS:
            options.append(("", ITSELF))
        else:
            options.append(("", UNREADABLE))
        if c in LOOK:
            options += [(x, AS_LETTER) for x in LOOK[c]]
        if i < before or i >= after:
            options.append(("", ITSELF))  # punctuation around a word
        elif c in "*!+|(" or c == stretch[i - 1 : i]:
            options.append(("", DROPPED))
        out.append(options)
    return out


def likeliest(stretch: str, letters: Letters) -> tuple[float, str]:
    """Log probability and letters of the best path: Viterbi over states of the last two."""
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    logs = letters.logs
    for options in lattice(stretch):
        new: dict[str, tuple[float, tuple]] = {}
        for context, (score, path) in states.items():
            for letter, cost in options:
                total = score + cost + (logs[context + letter] if letter else 0.0)
                to = context[1] + letter if letter else context
                if to not in new or total > new[to][0]:
                    new[to] = (total, (path, letter) if letter else path)
        states = new
    best, path = max(((score + logs[context + "$"], path) for context, (score, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return best, "".join(reversed(out))


def decode(stretch: str, letters: Letters) -> str:
    """The likeliest letters."""
    return likeliest(stretch, letters)[1]


def features(word: str) -> list[str]:
    """The word itself, its beginnings, and those with its length."""
    starts = [word[:n] for n in PREFIXES if len(word) >= n]
    return [f"={word}", *starts, *(f"{x}|{len(word)}" for x in starts)]


class Restorer(dict):
    """Stretch to restored words; what was decoded before is kept."""

    def __init__(self, letters: Letters):
        super().__init__()
        self.letters = letters

    def __missing__(self, stretch: str) -> tuple[str, ...]:
        out: tuple[str, ...] = ()
        if any(map(str.isalpha, stretch)):
            best, text = likeliest(stretch, self.letters)
            signs = [c for c in stretch if c not in SEPARATORS]
            # against leaving it as it is
            if all(map(str.isalpha, signs)) or best > (len(signs) + 1) * AS_IS:
                out = tuple(_WORD.findall(text))
        if len(self) < CACHE:
            self[stretch] = out
        return out

    def variants(self, word: str) -> tuple[str, ...]:
        """The word, and what it is without its repeats if a letter comes twice in a row."""
        return (word, *self[word]) if _DOUBLE.search(word) else (word,)

    def words(self, text: str) -> set[str]:
        """The distinct words of a text, with those of its restored stretches; for repeated letters see variants."""
        low = text.lower()
        out = set(_WORD.findall(low))
        for m in _LOOSE.finditer(low):
            out.update(self[m.group()])
            for same in _SPACED.finditer(m.group()):  # what the one finds lies in what the other finds
                out.update(self[same.group()])
        for m in _MIXED.finditer(low):
            out.update(self[m.group()])
        return out


@dataclass
class Model:
    letters: Letters
    weights: dict[str, float]
    logistic: tuple[float, float, float]  # constant, greatest evidence, log of the sum

    @cached_property
    def readers(self) -> tuple[Restorer, Evidence]:
        """One of each for all tasks of a worker, so a word is decoded once in each worker (results don't depend on it)."""
        restorer = Restorer(self.letters)
        return restorer, Evidence(self.weights, restorer)

    def score(self, top: float, total: float) -> float:
        a, b, c = self.logistic
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * top + c * math.log1p(total)))))


class Evidence(dict):
    """Word to its evidence."""

    def __init__(self, weights: dict[str, float], restorer: Restorer):
        super().__init__()
        self.weights, self.restorer = weights, restorer
        self.starts = {f.lstrip("=").split("|")[0][:4] for f in weights}  # most words begin like no feature
        self.once = {_RUN.sub(r"\1", x) for x in self.starts}

    def may_tell(self, word: str) -> bool:
        """False if neither the word nor what it may be without repeats begins like a feature: of a run of one letter some
        stay, so letters of runs in order are those of the word."""
        if not _DOUBLE.search(word):
            return word[:4] in self.starts
        once = _RUN.sub(r"\1", word)
        return not word.isalpha() or any(once[:n] in self.once for n in range(1, 5))

    def __missing__(self, word: str) -> float:
        out = 0.0
        if self.may_tell(word):
            out = max((self.weights.get(f, 0.0) for w in self.restorer.variants(word) if w[:4] in self.starts for f in features(w)), default=0.0)
        if len(self) < CACHE:
            self[word] = out
        return out


def measure(text: str | None, restorer: Restorer, evidence: Evidence) -> tuple[float, float]:
    found = [e for e in map(evidence.__getitem__, restorer.words(text or "")) if e > 0]
    return max(found, default=0.0), sum(found)


def leaning(counted: DataFrame, ones: int, zeros: int, seen: int) -> DataFrame:
    """name, pos, neg of the features that lean to label 1 more than chance allows among all that were seen three times."""
    rate = ones / (ones + zeros)
    pos, neg, share = F.col("pos"), F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = pos * F.log(share / rate) + F.when(neg > 0, neg * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return counted.filter((F.col("name") != "") & (pos >= 3) & (share >= max(rate, MIN_SHARE)) & (gain >= math.log(max(seen, 2)) + 0.5))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method with a small penalty on all but the constant."""
    x = np.column_stack([np.ones(len(y)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter as _WORD has it."""
    return np.array([_WORD.match(chr(k)) is not None for k in range(0x110000)])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the words of a text (three code points in a number; ^^ begins a word, $ ends it) and their counts."""
    codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    known = _letters()[codes]
    at = np.flatnonzero(known[2:] | known[1:-1]) + 2
    last = np.where(known[at], codes[at], ord("$"))
    one = np.where(known[at - 1], codes[at - 1], ord("^"))
    two = np.where(known[at - 1] & known[at - 2], codes[at - 2], ord("^"))
    present = np.zeros(0x110000, bool)
    for x in (last, one, two):
        present[x] = True
    alphabet = np.flatnonzero(present)
    k = len(alphabet)
    if k > 150:
        return np.unique(two << 42 | one << 21 | last, return_counts=True)
    place = np.cumsum(present) - 1
    n = np.bincount((place[two] * k + place[one]) * k + place[last], minlength=k**3)
    found = np.flatnonzero(n)
    return alphabet[found // k**2] << 42 | alphabet[found // k % k] << 21 | alphabet[found % k], n[found]


def language(docs: DataFrame) -> Letters:
    """The trigram model of all words of all documents: workers count, only distinct grams with their sums reach the driver."""
    python_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["gram", "n"])

        for b in batches:
            keys, n = trigrams("\n".join(filter(None, b.column("text").to_pylist())))
            held.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
            if len(held) > FLUSH_GRAMS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    every = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    c: Counter = Counter()
    for r in every.toLocalIterator():
        gram = "".join(chr(r["gram"] >> k & 0x1FFFFF) for k in (42, 21, 0))
        for k in (0, 1, 2):
            c[gram[k:]] += r["n"]
            c[gram[k:2] + "\0"] += r["n"]
    return Letters(dict(c))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """Learns from labels outside the held-out fold."""
    spark = docs.sparkSession
    python_batches(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, held))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(MAX_TRAIN)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most MAX_TRAIN rows of two integers
    letters = language(docs)
    sent = spark.sparkContext.broadcast(Model(letters, {}, (0.0, 0.0, 0.0)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, _ = sent.value.readers
        for b in batches:
            pos, neg = Counter(), Counter()
            docs_of = [0, 0]
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                docs_of[y > 0] += 1
                (pos if y > 0 else neg).update({f for w in restorer.words(text or "") for v in restorer.variants(w) for f in features(v)})
            names = sorted(pos | neg)
            cols = [["", *names], [docs_of[1], *(pos[x] for x in names)], [docs_of[0], *(neg[x] for x in names)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["name", "pos", "neg"])

    counted = rows.select("text", "y").mapInArrow(tally, "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
    whole = counted.filter("name = ''").first()
    if whole is None or not whole["pos"] or not whole["neg"]:
        counted.unpersist()
        return Model(letters, {}, (-30.0, 0.0, 0.0))
    seen = counted.filter("pos + neg >= 3").count()
    # of the labelled sample's features, those few that tell something
    top = leaning(counted, whole["pos"], whole["neg"], seen).collect()
    counted.unpersist()
    weight = lambda r: math.log((r["pos"] + 0.5) / (whole["pos"] + 1)) - math.log((r["neg"] + 0.5) / (whole["neg"] + 1))
    weights = {r["name"]: weight(r) for r in sorted(top, key=lambda r: r["name"])}
    # a disguise hides such a word more often than any other, so the decoder expects them: a fiftieth of all words
    toxic_words = [f[1:] for f in weights if f[0] == "="]
    letters = letters.plus({w: max(1, letters.total // (50 * len(toxic_words))) for w in toxic_words})
    bound = spark.sparkContext.broadcast(Model(letters, weights, (0.0, 0.0, 0.0)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, evidence = bound.value.readers
        for b in batches:
            got = [measure(t, restorer, evidence) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([t for t, _ in got], pa.float64()), pa.array([s for _, s in got], pa.float64())], ["y", "top", "total"])

    seen_rows = rows.select("text", "y").mapInArrow(look, "y int, top double, total double").toPandas()
    w = logistic(np.column_stack([seen_rows["top"], np.log1p(seen_rows["total"])]), seen_rows["y"].to_numpy(float))
    return Model(letters, weights, tuple(map(float, w)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    spark = docs.sparkSession
    python_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # weights of the labelled sample's features and one count for each distinct gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        restorer, evidence = model.readers
        for b in batches:
            got = [model.score(*measure(t, restorer, evidence)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    out = score(docs, fit(docs, labels, folds, held))
    return out.select("doc_id", held_out("doc_id", folds, held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

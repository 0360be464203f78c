"""Language identification, words first: a known word is scored by its log frequency in each language; an unknown one by
its character n-grams, the longest length of which any is known.

Learning takes about PER_LANGUAGE documents of each language (all of a rarer one), chosen by a hash of the key; of those
the model has every language, every word and every n-gram, so no language is crowded out by others. Scores are sparse: a
word or n-gram has an entry for each language it was seen in, all others share one number a language, so the model grows
with what the sample holds and not with languages times words. Learning and prediction find words by one function.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned;
ties go to the first language by name; repeated rows keep their own result; an empty table gives no rows; further columns
are ignored. Texts are read whole however long; a long one is scored by itself in time and memory in proportion to it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, held_out, python_batches, staged

#: Documents of a language that a fit reads, on average.
PER_LANGUAGE = 2000
LONGEST = 5
#: Unknown words whose scores a worker keeps from batch to batch.
CACHE = 300_000
#: Texts are scored together until they have so many words.
TOGETHER = 1 << 17
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Scores:
    """Log frequencies by language: base, and for each name what the languages it was seen in have above that."""

    names: dict[str, int] = field(default_factory=dict)
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    language: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    above: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def row(self, name: str, languages: int) -> np.ndarray:
        """The log frequencies of a known name."""
        some = slice(*self.at[self.names[name] :][:2])
        out = self.base.copy() if len(self.base) else np.zeros(languages)
        out[self.language[some]] += self.above[some]
        return out


@dataclass
class Model:
    languages: list[str]
    words: Scores = field(default_factory=Scores)
    grams: Scores = field(default_factory=Scores)

    def unknown(self, word: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Languages and means above base of the known n-grams of the greatest length that has any; None without any."""
        g = self.grams
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            rows = [i for x in grams(word, n) if (i := g.names.get(x)) is not None]
            if rows:
                some = np.concatenate([np.arange(g.at[i], g.at[i + 1]) for i in rows])
                total = np.bincount(g.language[some], g.above[some], len(self.languages))
                seen = np.flatnonzero(total)
                return seen, total[seen] / len(rows)
        return None


def _scores(languages: list[str], rows: list[tuple[str, str, int]], total: np.ndarray) -> Scores:
    """From (language, name, count), each pair once, and what the counts of a language are a share of.

    A frequency is (count + 1/2) / (total + (names + 1) / 2); what a count has above none is log(2 count + 1).
    """
    names = {x: i for i, x in enumerate(sorted({x for _, x, _ in rows}))}
    number = {x: i for i, x in enumerate(languages)}
    name = np.fromiter((names[x] for _, x, _ in rows), np.int64, len(rows))
    language = np.fromiter((number[x] for x, _, _ in rows), np.int32, len(rows))
    count = np.fromiter((n for _, _, n in rows), float, len(rows))
    order = np.lexsort((language, name))
    at = np.searchsorted(name[order], np.arange(len(names) + 1))
    return Scores(names, at, language[order], np.log1p(2 * count[order]).astype(np.float32), np.log(0.5 / (total + 0.5 * (len(names) + 1))))


def pieces(rows: Iterable[tuple[str, str, int]]) -> Counter:
    """(language, n-gram) to count, from (language, word, count)."""
    out: Counter = Counter()
    for lang, word, n in rows:
        for k in range(1, LONGEST + 1):
            for g in grams(word, k):
                out[lang, g] += n
    return out


def build(words: list[tuple[str, str, int]], parts: list[tuple[str, str, int]]) -> Model:
    """From (language, word, count) and (language, n-gram, count)."""
    languages = sorted({lang for lang, _, _ in words})
    total = lambda rows: np.array([c.get(x, 0) for x in languages], float) if (c := _sums(rows)) else np.zeros(len(languages))
    return Model(languages, _scores(languages, words, total(words)), _scores(languages, parts, total(r for r in parts if len(r[1]) == 1)))


def _sums(rows: Iterable[tuple[str, str, int]]) -> Counter:
    out: Counter = Counter()
    for lang, _, n in rows:
        out[lang] += n
    return out


_COUNTS = "lang string, name string, n long"


def _counts(rows: Counter) -> pa.RecordBatch:
    """A batch of _COUNTS from (language, name) to count."""
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()), pa.array(rows.values(), pa.int64())], ["lang", "name", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: Counter = Counter()
        for lang, text in zip(*(b.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            for word, n in Counter(words_of(text)).items():
                out[lang, word] += n
        yield _counts(out)


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _counts(pieces(zip(*(b.column(c).to_pylist() for c in ("lang", "name", "n")), strict=True)))


def fit(docs: DataFrame, folds: int = 3, held: int = 1) -> Model:
    """Learns from documents outside the held-out fold.

    What reaches the driver are counts by language of the words and n-grams of the sampled documents.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, held))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([])
    python_batches(docs.sparkSession)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, PER_LANGUAGE / n)))])[F.col("lang")]
    taken = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    summed = lambda df: df.groupBy("lang", "name").agg(F.sum("n").alias("n"))
    words = staged(summed(taken.select("lang", "text").mapInArrow(_count_words, _COUNTS)), "language-words")
    rows = lambda df: list(zip(*(c.to_pylist() for c in df.toArrow().columns), strict=True))
    model = build(rows(words), rows(summed(words.mapInArrow(_count_pieces, _COUNTS))))
    discard(words)
    return model


class _Rows(dict):
    """Word to row of sparse scores; unknown words get rows of their own, which are given up when there are too many."""

    def __init__(self, model: Model):
        super().__init__(model.words.names)
        self.model, self.fixed, self.entries = model, len(self), len(model.words.language)
        self.at, self.language, self.above = model.words.at, model.words.language, model.words.above
        self.base = np.stack([np.zeros(len(model.languages)), model.words.base, model.grams.base]) if model.languages else np.zeros((3, 0))
        self.kind = np.ones(self.fixed, np.int8)
        self.fresh: list[tuple[np.ndarray, np.ndarray] | None] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(self.model.unknown(word))
        return at

    def settle(self) -> None:
        """The rows of words met since the last call."""
        some = [x or (np.zeros(0, np.int32), np.zeros(0)) for x in self.fresh]
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x, _ in some], dtype=np.int64)])
        self.language = np.concatenate([self.language, *[x.astype(np.int32) for x, _ in some]])
        self.above = np.concatenate([self.above, *[x.astype(np.float32) for _, x in some]])
        self.kind = np.concatenate([self.kind, np.array([0 if x is None else 2 for x in self.fresh], np.int8)])
        self.fresh = []

    def room(self) -> None:
        if len(self) > self.fixed + CACHE:
            self.clear()
            self.update(self.model.words.names)
            self.at, self.language, self.above, self.kind = self.at[: self.fixed + 1], self.language[: self.entries], self.above[: self.entries], self.kind[: self.fixed]

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Scores of texts, given as words, by language."""
        self.room()
        size = np.array([len(x) for x in texts])
        row = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, size.sum())
        if self.fresh:
            self.settle()
        doc, n = np.repeat(np.arange(len(texts)), size), self.at[row + 1] - self.at[row]
        entry = np.arange(n.sum()) + np.repeat(self.at[row] - np.cumsum(n) + n, n)
        k = len(self.model.languages)
        above = np.bincount(np.repeat(doc, n) * k + self.language[entry], self.above[entry], len(texts) * k).reshape(len(texts), k)
        kinds = np.bincount(doc * 3 + self.kind[row], minlength=len(texts) * 3).reshape(len(texts), 3)
        return above + kinds @ self.base


def predict_texts(rows: _Rows, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    some: list[list[str]] = []

    def flush() -> Iterator[tuple[str, float]]:
        for words, total in zip(some, rows.totals(some) if rows.model.languages else some, strict=True):
            if not rows.model.languages or not any(map(str.isalpha, chain.from_iterable(words))):
                yield UNDETERMINED, 0.0
            else:
                best = int(total.argmax())
                yield rows.model.languages[best], float(1 / np.exp(total - total[best]).sum())
        some.clear()

    held = 0
    for t in texts:
        some.append(words_of(t or ""))
        held += len(some[-1])
        if held > TOGETHER:
            yield from flush()
            held = 0
    if some:
        yield from flush()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    spark = docs.sparkSession
    python_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # an entry for each language that a word or n-gram of the sample was seen in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(sent.value)
        for b in batches:
            got = list(predict_texts(rows, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    out = predict(docs, fit(docs, folds, held))
    return out.select("doc_id", held_out("doc_id", folds, held).alias("held_out"), "lang_pred", "score")

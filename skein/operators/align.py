"""Sliding alignment of a book's words to its frames, window by window, with the state of a book carried along.

A book's frames come in order of time and hold scores of sounds, or what a hook turns into them. A window takes some words
and the audio around the place reached so far; a monotone dynamic programme gives each word its frames; all words but the
last few of a window are committed, the others are aligned again in the next one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from skein.session import share_path

#: Sound 0 of the scores is the filler: pauses, noise and anything that is not the text.
FILLER = 0
#: Cells of the dynamic programme whose choices are held at once; beyond it, a part at a time is computed again.
CELLS = 1 << 26
#: Frames whose scores are made at once, and words that are handed on at once.
PIECE, HANDED = 1 << 13, 1 << 13

Spell = Callable[[str], list[int]]
Emit = Callable[[np.ndarray], np.ndarray]
#: First frame, frame after the last, and score of each word.
Way = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Rules:
    """Books up to whole seconds are aligned at once; others in windows of words and seconds, with a lead-in before the
    place reached, tail words left for the next window, until less than least seconds are left."""

    whole: float = 1700.0
    words: int = 400
    seconds: float = 600.0
    lead: float = 8.0
    tail: int = 25
    least: float = 5.0


class Feed:
    """A book's frames, as many as asked for, those given up dropped."""

    def __init__(self, frames: Iterator[np.ndarray]):
        self.frames, self.held, self.first, self.ended = frames, [], 0, False

    @property
    def end(self) -> int:
        return self.first + sum(map(len, self.held))

    def reach(self, frame: int) -> bool:
        """Whether there is such a frame; reads on until it is known."""
        while self.end <= frame and not self.ended:
            got = next(self.frames, None)
            if got is None:
                self.ended = True
            else:
                self.held.append(got)
        return frame < self.end

    def all(self) -> int:
        """The number of frames, read to the end."""
        while not self.ended:
            self.reach(self.end)
        return self.end

    def take(self, keep: int, lo: int, hi: int) -> np.ndarray:
        """Frames lo to hi; those before keep are given up."""
        keep = max(keep, self.first)
        whole = np.concatenate(self.held) if self.held else np.zeros((0, 1))
        whole = whole[keep - self.first :]
        self.held, self.first = [whole], keep
        return whole[lo - keep : hi - keep]


@dataclass(frozen=True)
class States:
    """Filler, a word's sounds, filler, and so on; words without sounds have none."""

    sounds: np.ndarray
    owner: np.ndarray  # the word, -1 for the filler
    skip: np.ndarray  # whether the way may come from two states before, past a filler
    spent: np.ndarray  # sounds up to and with the state

    @classmethod
    def of(cls, words: list[list[int]]) -> States:
        rows = [(FILLER, -1, False)]
        for w, spelled in enumerate(words):
            rows += [(s, w, k == 0 and len(rows) > 1) for k, s in enumerate(spelled)]
            rows += [(FILLER, -1, False)] * bool(spelled)
        sounds, owner, skip = (np.array(x) for x in zip(*rows, strict=True))
        return cls(sounds, owner, skip, np.cumsum(owner >= 0))

    def bands(self, n: int) -> np.ndarray:
        """For each of n frames the states from lo to hi that the frames so far can have reached and from which the rest can
        still reach the end."""
        t = np.arange(n)
        lo = np.searchsorted(self.spent, self.spent[-1] - (n - 1 - t), side="left")
        return np.stack([lo, np.searchsorted(self.spent - (self.owner >= 0), t, side="right")], axis=1)


def _steps(scores: np.ndarray, s: States, bands: np.ndarray, best: np.ndarray, at: int, choose: np.ndarray | None) -> np.ndarray:
    """best after the frames of bands, from frame at on; choose gets how many states back each state's best way came from."""
    closed = np.where(s.skip, 0.0, -np.inf)
    for t, (lo, hi) in enumerate(bands.tolist(), at):
        emitted, new = scores[t, s.sounds[lo:hi]], np.full(len(best), -np.inf)
        if t == 0:
            new[lo : min(hi, 2)] = emitted[: max(0, min(hi, 2) - lo)]
        else:
            before = np.concatenate([[-np.inf, -np.inf], best])
            stay, one, two = before[lo + 2 : hi + 2], before[lo + 1 : hi + 1], before[lo:hi] + closed[lo:hi]
            near = np.maximum(stay, one)
            new[lo:hi] = np.maximum(near, two) + emitted
            if choose is not None:  # of equal ways the one that stays, then the next state
                choose[t - at, lo:hi] = np.where(two > near, 2, one > stay)
        best = new
    return best


def clear_way(scores: np.ndarray, words: list[list[int]]) -> Way | None:
    """The way of the programme where each frame's best sound alone shows it; None if it does not, whatever the way is.

    Each frame has one best sound; runs of frames with the same are heard. If they are the words' sounds one for one, any
    other way loses somewhere. If more is heard, the words take the earliest runs that fit, and the filler the others, which
    costs. That is the best way, and of equal ones the one that the programme takes, if no run left out costs more as filler
    than a run taken would, and if a frame in a sound that is neither its best nor the filler costs twice that: a run that is
    not entered costs what it does as filler, or such a frame (of which one may stand for two runs), and no way enters
    more runs than there are sounds.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sounds = np.fromiter(itertools.chain.from_iterable(words), np.int64, sizes.sum())
    n = len(scores)
    if not n or not len(sounds):
        return None
    x = np.ascontiguousarray(scores.T)
    top = x.max(axis=0)
    best = x == top
    if not np.isfinite(top).all() or np.count_nonzero(best) != n:
        return None
    label = np.empty(n, np.int64)
    rows, cols = np.nonzero(best)
    label[cols] = rows
    edges = np.flatnonzero(label[1:] != label[:-1]) + 1
    first, last = np.append(0, edges), np.append(edges, n)
    heard = label[first]
    first, last, heard = (v[heard != FILLER] for v in (first, last, heard))
    if len(heard) == len(sounds):
        inner = np.ones(len(sounds), bool)
        inner[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = False
        inner = np.flatnonzero(inner)
        if (heard != sounds).any() or (first[inner] != last[inner - 1]).any():
            return None
    else:
        if len(heard) < len(sounds) or sizes.max() > 1:
            return None
        taken, at, runs = [], -1, heard.tolist()
        try:
            for s in sounds.tolist():
                at = runs.index(s, at + 1)
                taken.append(at)
        except ValueError:
            return None
        filled = np.append(0.0, np.cumsum(top - x[FILLER], dtype=float))
        cost = filled[last] - filled[first]
        most = np.delete(cost, taken).max()
        others = np.where(best, -np.inf, x)
        others[FILLER] = -np.inf
        if not np.isfinite(filled[-1]) or cost[taken].min() < most or (top - others.max(axis=0)).min() < 2 * most:
            return None
        first, last = first[taken], last[taken]
    # words: from their first sound to their last; those without sounds end where the one before does
    ends = np.append(0, last)[np.cumsum(sizes)]
    starts = ends.copy()
    spoken = sizes > 0
    starts[spoken] = first[(np.cumsum(sizes) - sizes)[spoken]]
    gained = np.zeros(len(words))
    gained[spoken] = np.add.reduceat(np.append(top, 0).astype(float), np.stack([starts[spoken], ends[spoken]], axis=1).ravel())[::2]
    return starts, ends, gained


def monotone(scores: np.ndarray, words: list[list[int]]) -> list[tuple[int, int, float]] | None:
    """The best way, word by word."""
    got = best_way(scores, words)
    return got and list(zip(*(x.tolist() for x in got), strict=True))


def best_way(scores: np.ndarray, words: list[list[int]]) -> Way | None:
    """By the frames' best sounds where these show the way, else by the programme."""
    return clear_way(scores, words) or programme(scores, words)


def programme(scores: np.ndarray, words: list[list[int]]) -> Way | None:
    """First frame, frame after the last, and score of each word: the best way through all frames in order.

    Every sound of a word takes at least one frame; between words, before and after them the filler may take any number. Of
    equally good ways, words come as early as they can, the last word first. A word without sounds takes no frames, at the
    place where the one before ends. A score that is no number is the worst. None if there are too few frames, or no way
    with a finite score.
    """
    n, s = len(scores), States.of(words)
    if n == 0 or s.spent[-1] > n:
        return None
    scores = np.where(np.isnan(scores), -np.inf, scores)
    bands, states = s.bands(n), len(s.sounds)
    edges = range(0, n, max(1, CELLS // states))
    saved, best = [], np.full(states, -np.inf)
    for a, b in itertools.pairwise(edges):
        saved.append(best)
        best = _steps(scores, s, bands[a:b], best, a, None)
    saved.append(best)
    state, path = -1, np.empty(n, np.int64)
    for a in reversed(edges):
        part = bands[a : a + edges.step]
        choose = np.zeros((len(part), states), np.uint8)
        best = _steps(scores, s, part, saved.pop(), a, choose)
        if state < 0:
            state = max(range(states - 1, max(-1, states - 3), -1), key=best.__getitem__)
            if best[state] == -np.inf:
                return None
        for t in range(a + len(part) - 1, a - 1, -1):
            path[t] = state
            state -= int(choose[t - a, state])
    own, gained = s.owner[path], scores[np.arange(n), s.sounds[path]]
    out, last = [], 0
    firsts = dict(zip(*(x.tolist() for x in np.unique(own, return_index=True)), strict=True))
    sizes = np.bincount(own[own >= 0], minlength=len(words))
    for w in range(len(words)):
        first = firsts.get(w, last)
        last = first + int(sizes[w])
        out.append((first, last, float(gained[first:last].sum())))
    starts, ends, sums = zip(*out, strict=True) if out else ((), (), ())
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(sums, float)


def align_book(words: list[str], feed: Feed, spell: Spell, rate: float, rules: Rules) -> Iterator[tuple[int, int, int, list[tuple[int, int, float]]]]:
    """Windows of a book: place of the first word, the audio's first frame and the one after its last, committed words."""
    for i, lo, hi, got in windows(words, feed, spell, rate, rules):
        yield i, lo, hi, list(zip(*(x.tolist() for x in got), strict=True))


def windows(words: list[str], feed: Feed, spell: Spell, rate: float, rules: Rules) -> Iterator[tuple[int, int, int, Way]]:
    """The same, committed words as arrays."""
    if not feed.reach(int(rules.whole * rate)):
        n = feed.all()
        got = best_way(feed.take(0, 0, n), [spell(w) for w in words]) if words else None
        if got:
            yield 0, 0, n, got
        return
    i, cursor, lead = 0, 0, int(rules.lead * rate)
    while i < len(words):
        if not feed.reach(cursor + int(rules.seconds * rate)) and feed.all() - cursor < rules.least * rate:
            return
        some = words[i : i + rules.words]
        last = i + len(some) >= len(words)
        lo = max(feed.first, cursor - lead)
        hi = feed.all() if last else min(cursor + int(rules.seconds * rate), feed.end)
        # a place reached in the lead-in takes the next window back: as much is held before a window as one takes after it
        got = best_way(feed.take(lo - int(rules.seconds * rate), lo, hi), [spell(w) for w in some])
        if not got:
            return
        n = len(some) if last else max(1, len(some) - rules.tail)
        first, after, gained = (x[:n] for x in got)
        yield i, lo, hi, (lo + first, lo + after, gained)
        i, cursor = i + n, lo + int(after[-1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """Pieces of the batches with one key and kind each."""
    for b in batches:
        marks = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        at = 0
        for (key, kind), same in itertools.groupby(marks):
            size = len(list(same))
            yield key, kind, b.slice(at, size)
            at += size


def align_words(words: DataFrame, frames: DataFrame, spell: Spell, rate: float, key: str = "book", emit: Emit | None = None, rules: Rules = Rules(), width: int | None = None) -> DataFrame:  # noqa: B008
    """key, pos, text, start, end, score, window, win_start, win_end of each word that found its place, times in seconds.

    words has key, pos and text; frames has key, frame (from 0 on) and scores, an array for each frame: scores of sounds, or
    what emit turns into them, many frames at once. spell gives a word's sounds. rate: frames a second. Rows may hold many:
    text as an array has the words from pos on, and with width scores are those of the frames from frame on, so many each.

    One book is one task's work, as each window begins where the one before ended; a task holds a book's words and the
    frames of two windows (of books up to rules.whole seconds all, and of the last window what is left), whatever the book's
    length. Windows that go back, one after the other, end at the first frame that is held. Books without words or frames give no rows; a null text has no sounds; words left when the audio ends have no
    rows; a null text counts as an empty one; of frames with one number any order holds.
    """
    return _aligned(words, frames, spell, rate, key, emit, rules, width, report=False)


def align_windows(words: DataFrame, frames: DataFrame, spell: Spell, rate: float, key: str = "book", emit: Emit | None = None, rules: Rules = Rules(), width: int | None = None) -> DataFrame:  # noqa: B008
    """window_report of align_words, a row for each window and none for its words."""
    return _aligned(words, frames, spell, rate, key, emit, rules, width, report=True)


def _aligned(words: DataFrame, frames: DataFrame, spell: Spell, rate: float, key: str, emit: Emit | None, rules: Rules, width: int | None, report: bool) -> DataFrame:
    share_path(words.sparkSession)
    kind = words.schema[key].dataType.simpleString()
    inner = frames.schema["scores"].dataType.simpleString()
    plain = lambda c: F.coalesce(c, F.lit(""))
    said = F.transform("text", plain) if isinstance(words.schema["text"].dataType, ArrayType) else F.array(plain("text"))
    text = words.select(F.col(key).alias("key"), F.lit(False).alias("sound"), F.col("pos").cast("long").alias("at"), said.alias("text"), F.lit(None).cast(inner).alias("scores"))
    audio = frames.select(F.col(key).alias("key"), F.lit(True).alias("sound"), F.col("frame").cast("long").alias("at"), F.lit(None).cast("array<string>").alias("text"), F.col("scores"))
    # a number of parts of our own, which adaptive plans leave as it is: what a part costs is not its bytes
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = text.unionAll(audio).repartition(4 * parts, "key").sortWithinPartitions("key", "sound", "at")

    def blocks(piece: pa.RecordBatch) -> Iterator[np.ndarray]:
        got = piece.column(4)
        flat = got.flatten().to_numpy(zero_copy_only=False)
        flat = flat.reshape(-1, width) if width else flat.reshape(len(got), -1)
        for k in range(0, len(flat), PIECE):
            some = flat[k : k + PIECE].astype(float)
            yield emit(some) if emit else some

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Columns of each window or of its words."""
        for book, pieces in itertools.groupby(_runs(batches), key=lambda p: p[0]):
            spoken, places = [], []
            pieces = iter(pieces)
            rest = None
            for _, sound, piece in pieces:
                if sound:
                    rest = piece
                    break
                at, sizes = piece.column(2).to_numpy(zero_copy_only=False), piece.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                places.append(np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))
                spoken += piece.column(3).flatten().to_pylist()
            if rest is None or not spoken:
                continue
            places = np.concatenate(places)
            feed = Feed(x for p in itertools.chain([rest], (p for _, _, p in pieces)) for x in blocks(p))
            for window, (i, lo, hi, (first, after, gained)) in enumerate(windows(spoken, feed, spell, rate, rules)):
                n = len(first)
                if report:
                    yield [pa.array([book], key_type), *map(pa.array, (np.array([window], np.int32), places[i : i + n].min(keepdims=True), [n], [lo / rate], [hi / rate], [float(after.max()) / rate]))]
                    continue
                yield [pa.array([book] * n, key_type), pa.array(places[i : i + n], pa.int64()), pa.array(spoken[i : i + n], pa.string()),
                       *map(pa.array, (first / rate, after / rate, gained, np.full(n, window, np.int32), np.full(n, lo / rate), np.full(n, hi / rate)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for line in itertools.chain(lines(batches), [None]):
            held += [line] if line else []
            if held and (not line or sum(len(x[0]) for x in held) >= HANDED):
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=names)
                held = []

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(words.schema[key].dataType)
    columns = "window int, first long, committed long, win_start double, win_end double, reached double" if report else "pos long, text string, start double, end double, score double, window int, win_start double, win_end double"
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    return both.mapInArrow(run, f"{key} {kind}, {columns}")


def window_report(aligned: DataFrame, key: str = "book") -> DataFrame:
    """Per book and window: first word, words committed, its audio, and where the next window begins."""
    return aligned.groupBy(key, "window").agg(F.min("pos").alias("first"), F.count("*").alias("committed"), F.first("win_start").alias("win_start"), F.first("win_end").alias("win_end"), F.max("end").alias("reached"))

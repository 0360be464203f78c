"""Matching recordings to books: candidates, tiers, verification, staging plans, reviews."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T

STRONG, AUTHOR, TITLE = 0.85, 0.85, 0.6
#: Rows of the books' table up to which it is sent to every executor; more of them are dealt out.
BROADCAST_BOOKS = 100_000
TIERS = ("strong", "title-only", "author-only", "weak", "none")


def repair_swap(df: DataFrame) -> DataFrame:
    """Where work only says that it is a folk tale, the author column holds the work."""
    swapped = F.contains(F.lower("work"), F.lit("halq masal"))
    return df.withColumns({"work": F.when(swapped, F.col("author")).otherwise(F.col("work")), "author": F.when(swapped, "").otherwise(F.col("author"))})


def parse_title(title: Column) -> Column:
    """author and work of `author. work`; all is the work if nothing follows or the author has over four words."""
    cut = F.instr(title, ".")
    author, work = F.trim(F.substring(title, F.lit(1), cut - 1)), F.trim(F.substring(title, cut + 1, F.length(title)))
    whole = (cut == 0) | (work == "") | (F.size(T.words(author)) > 4)
    return F.struct(F.when(whole, "").otherwise(author).alias("author"), F.when(whole, F.trim(title)).otherwise(work).alias("work"))


def has_name(c: Column) -> Column:
    """False for names of digits and spaces only."""
    return ~c.rlike(r"(?U)^[\d\s]*$")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All recordings in one schema; columns that a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def tier(score_title: Column, score_author: Column, title_tokens: Column, least: float = TITLE) -> Column:
    return (
        F.when(score_title.isNull(), "none")
        .when((score_title >= least) & (score_author >= AUTHOR) & (title_tokens >= 2), "strong")
        .when((score_title >= least) & (title_tokens >= 2), "title-only")
        .when(score_author >= AUTHOR, "author-only")
        .otherwise("weak")
    )


def total_score(title: Column, author: Column) -> Column:
    return F.lit(0.55) * title + F.lit(0.45) * F.when(author >= AUTHOR, author).otherwise(0.0)


def letter_marks(c: Column) -> Column:
    """64 bits of a token: which of 32 classes of letters it has, and which of them twice or more.

    Bits in which two tokens differ are letters that one has more of, so there are at least as many of those; all bits of a
    part of a token are set in it too.
    """

    def mark(seen: Column, x: Column) -> Column:
        once = F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % 32)
        return seen.bitwiseOR(F.when(seen.bitwiseAND(once) == 0, once).otherwise(F.shiftleft(once, 32)))

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), mark)


def near_pairs(asked: DataFrame, held: DataFrame) -> DataFrame:
    """_q, _p of the tokens asked and held that may hit, and whether one lies inside the other.

    Letters that only one of both has are no match: pairs with too many of them for a hit are left out.
    """
    asked, held = asked.withColumn("_qm", letter_marks(F.col("_q"))), held.withColumn("_pm", letter_marks(F.col("_p")))
    q, p, qm, pm = F.length("_q"), F.length("_p"), F.col("_qm"), F.col("_pm")
    lacks = lambda x, y: x.bitwiseAND(F.bitwise_not(y)) != 0
    inside = (q >= 6) & (~lacks(qm, pm) & F.contains("_p", F.col("_q")) | ~lacks(pm, qm) & F.contains("_q", F.col("_p")))
    # what is equal in both is no longer than the shorter
    near = (200 * F.least(q, p) >= 85 * (q + p)) & (100 * F.bit_count(qm.bitwiseXOR(pm)) <= 15 * (q + p))
    if held.limit(BROADCAST_BOOKS + 1).count() <= BROADCAST_BOOKS:
        held = F.broadcast(held)
    elif asked.limit(BROADCAST_BOOKS + 1).count() <= BROADCAST_BOOKS:
        asked = F.broadcast(asked)
    # dealt out for the pairs to come, which adaptive plans can't tell from the tokens' bytes
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(parts, "_q").join(held, inside | near).select("_q", "_p", inside.alias("_inside"))


def token_hits(asked: DataFrame, held: DataFrame) -> DataFrame:
    """_q, _p, _v of the distinct tokens asked (_q) and held (_p) where p alone makes a hit of q (STRONG, AUTHOR at the
    least); _v is how alike they are."""

    def hit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(_v=[T.token_hit(x, [y], substring_ok=False) for x, y in zip(b["_q"], b["_p"], strict=True)])
            yield b.loc[b["_inside"] | (b["_v"] >= STRONG), ["_q", "_p", "_v"]]

    return near_pairs(asked, held).mapInPandas(hit, "_q string, _p string, _v double")


def hit_pairs(rec: DataFrame, books: DataFrame, top: int, least: float) -> DataFrame:
    """The scores of all pairs that can be among a recording's top and beyond least (0 or more), counted from the distinct
    tokens that hit each other; a pair comes as often as its rows do."""
    some = rec.groupBy("id", "title_tokens", "author_tokens").agg(F.count("*").alias("_r"))
    asked = some.withColumn("_q", F.explode(F.array_distinct(F.concat("title_tokens", "author_tokens"))))
    # books of one path may have other tokens
    held = books.groupBy("path", "tokens").agg(F.count("*").alias("_b")).withColumn("_k", F.sha2(F.to_json("tokens"), 256))
    pool = held.select("path", "_k", "_b", F.explode(F.array_distinct("tokens")).alias("_p"))
    hits = token_hits(asked.select("_q").distinct(), pool.select("_p").distinct()).join(pool, "_p").groupBy("_q", "path", "_k", "_b").agg(F.max("_v").alias("_v"))
    said = F.size(F.filter("title_tokens", lambda x: x == F.col("_q")))
    author = F.max(F.when(F.array_contains("author_tokens", F.col("_q")) & (F.col("_v") >= AUTHOR), F.col("_v")))
    pairs = asked.withColumn("_n", said).join(hits, "_q").groupBy("id", "title_tokens", "author_tokens", "_r", "path", "_k", "_b").agg(F.sum("_n").alias("_n"), author.alias("author_score"))
    pairs = pairs.withColumn("title_score", F.when(F.size("title_tokens") > 0, F.col("_n") / F.size("title_tokens")).otherwise(0.0))
    score = total_score(F.col("title_score"), F.coalesce("author_score", F.lit(0.0)))
    ranked = pairs.withColumn("_s", score).filter(F.col("_s") > least).withColumn("_rank", F.rank().over(Window.partitionBy("id").orderBy(F.desc("_s"), F.desc("title_score")))).filter(F.col("_rank") <= top)
    # an author that makes no hit adds nothing to the score, but decides between equal ones
    unsure = F.col("author_score").isNull() & (F.size("author_tokens") > 0)
    of = held.select(F.col("path").alias("_path"), F.col("_k").alias("_key"), "tokens")
    ranked = ranked.join(of, F.col("path").eqNullSafe(F.col("_path")) & F.col("_k").eqNullSafe(F.col("_key")) & unsure, "left")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            a = [
                max((T.token_hit(x, list(pool), substring_ok=False) for x in author), default=0.0) if pool is not None else known
                for known, author, pool in zip(p["author_score"].fillna(0.0), p["author_tokens"], p["tokens"], strict=True)
            ]
            yield pd.DataFrame({"id": p["id"], "n_title": p["title_tokens"].map(len), "path": p["path"], "title_score": p["title_score"], "author_score": a, "_copies": p["_r"] * p["_b"]})

    weighed = ranked.select("id", "title_tokens", "author_tokens", "path", "tokens", "title_score", "author_score", "_r", "_b").mapInPandas(weigh, "id long, n_title int, path string, title_score double, author_score double, _copies long")
    return weighed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("_copies", F.lit(top))))).drop("_copies", "_copy")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """The scores of every pair."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            t, a = [], []
            for title, author, pool in zip(p["title_tokens"], p["author_tokens"], p["tokens"], strict=True):
                pool = list(pool)
                t.append(sum(T.token_hit(x, pool) >= STRONG for x in title) / len(title) if len(title) else 0.0)
                a.append(max((T.token_hit(x, pool, substring_ok=False) for x in author), default=0.0))
            yield pd.DataFrame({"id": p["id"], "n_title": p["title_tokens"].map(len), "path": p["path"], "title_score": t, "author_score": a})

    return pairs.select("id", "title_tokens", "author_tokens", "path", "tokens").mapInPandas(score, "id long, n_title int, path string, title_score double, author_score double")


def candidates(recordings: DataFrame, books: DataFrame, top: int = 3, least: float = 0.25, blocked: bool = False) -> DataFrame:
    """For each recording (id, author, work) the top books (path, tokens) by fuzzy score, best first.

    Every pair is scored (fuzzy hits need no word in common), on the recordings' partitions against the books in turn; with
    blocked only pairs with a token that hits another are, the others' score being 0: the same rows, as equality joins
    through the distinct tokens that hit each other.
    """
    rec = recordings.withColumns({"title_tokens": T.tokens(F.col("work")), "author_tokens": T.tokens(F.col("author"))}).filter((F.size("title_tokens") > 0) | (F.size("author_tokens") > 0))
    if blocked and least >= 0:
        scored = hit_pairs(rec, books, top, least)
    else:
        few = books.limit(BROADCAST_BOOKS + 1).count() <= BROADCAST_BOOKS
        scored = score_pairs(rec.crossJoin(F.broadcast(books) if few else books))  # every pair is scored, as asked
    scored = scored.withColumn("score", total_score(F.col("title_score"), F.col("author_score"))).filter(F.col("score") > least)
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("title_score"), F.desc("author_score"), F.desc("path"))
    return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).withColumn("tier", tier(F.col("title_score"), F.col("author_score"), F.col("n_title")))


def tier_counts(df: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Counts by value, in a fixed order, zero where none."""
    names = df.sparkSession.createDataFrame(list(enumerate(order)), f"pos int, {column} string")
    return names.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select("pos", column, F.coalesce("n", F.lit(0)).alias("n"))


def verdict(has_text: Column, title_tokens: Column, similarity: Column, token_ratio: Column) -> Column:
    return (
        F.when(~has_text, "unreadable")
        .when(title_tokens < 2, "inconclusive")
        .when(similarity >= 0.85, "confirmed")
        .when((similarity >= 0.70) | (token_ratio >= 0.6), "weak")
        .otherwise("absent")
    )


def verify(matches: DataFrame, books: DataFrame) -> DataFrame:
    """matches (id, work, book) with verdict and title_tokens_found; each book's skeleton is made once."""
    texts = books.join(matches.select("book").distinct(), "book", "left_semi").select("book", T.skeleton(F.col("text")).alias("sk"))
    j = matches.join(texts, "book", "left").withColumns({"sk": F.coalesce("sk", F.lit("")), "wt": T.tokens(F.col("work"))})
    j = j.withColumns({"share": F.coalesce(T.token_share(F.col("wt"), F.col("sk")), F.lit(0.0)), "sim": T.phrase_hit(T.skeleton(F.col("work")), F.col("sk"))})
    v = verdict(F.col("sk") != "", F.size("wt"), F.col("sim"), F.col("share"))
    found = F.when(v.isin("unreadable", "inconclusive"), 0.0).otherwise(F.greatest(F.col("share"), F.col("sim")))
    return j.select("id", "work", "book", v.alias("verdict"), found.alias("title_tokens_found"))


def collapse_works(matches: DataFrame, key: str, score: str, first_by: str) -> DataFrame:
    """One row a work: parts, the best score, and the row seen first."""
    return matches.groupBy(key).agg(F.count("*").alias("parts"), F.max(score).alias("best"), F.min_by(F.struct(*[c for c in matches.columns if c != key]), first_by).alias("first"))


def group_files(df: DataFrame, keys: list[str], pos: str, file: str, seconds: str) -> DataFrame:
    """By key: the files in order, how many, and their seconds."""
    files = F.transform(F.sort_array(F.collect_list(F.struct(pos, file))), lambda x: x[file])
    return df.groupBy(*keys).agg(files.alias("files"), F.count("*").alias("parts"), F.sum(seconds).alias("seconds"))


def staging(seconds: Column, chars: Column, pace: float = 14.0) -> Column:
    """kind (whole, sliced, skip) and note."""
    ratio = chars / F.nullif(seconds * pace, F.lit(0.0))
    kind = F.when((seconds < 20) | (chars < 200), "skip").when(ratio.between(0.45, 2.2), "whole").when(ratio > 2.2, "sliced").otherwise("skip")
    note = F.when(seconds < 20, "audio too short").when(chars < 200, "text too short").when(ratio < 0.45, "text too short for the audio").otherwise("")
    return F.struct(kind.alias("kind"), note.alias("note"))


def full_text(c: Column) -> Column:
    """The text if it says enough, else ''."""
    return F.when(F.length(F.trim(c)) > 200, c).otherwise("")


def page_window(pages: Column, cached: Column, head: int = 12, tail: int = 10) -> Column:
    """The first and last pages; a cached text instead if they say little and it says more."""
    n = F.size(pages)
    ends = F.concat(F.slice(pages, F.lit(1), F.lit(head)), F.slice(pages, F.greatest(n - tail, F.least(F.lit(head), n)) + 1, F.lit(tail)))
    own = F.array_join(ends, "\n")
    return F.when((F.length(own) < 200) & (F.length(F.coalesce(cached, F.lit(""))) > F.length(own)), cached).otherwise(own)


def excerpt(c: Column, longest: int = 700) -> Column:
    return F.substring(T.collapse(c), 1, longest)


def review_outcome(human: Column, folder: Column, transcript: Column) -> Column:
    """What a review leads to; why, if nothing."""
    return (
        F.when(folder.isNull(), "untouched(folder not found)")
        .when(human == "reject", "reject")
        .when((human == "ok") & (F.length(F.coalesce(transcript, F.lit(""))) >= 200), "promote")
        .when(human == "ok", "untouched(transcript too short)")
        .otherwise("untouched(no verdict)")
    )


#: Reviews show the doubtful first; a verdict that is not listed comes last.
REVIEW_ORDER = ("absent", "unreadable", "inconclusive", "weak", "confirmed")


def review_rank(v: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REVIEW_ORDER)), v), F.lit(0)) - 1, F.lit(9))

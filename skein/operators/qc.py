"""Quality gate, audit tags and reports over a table of clips (segments)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import words


def clips(docs: DataFrame) -> DataFrame:
    """Documents in the shape of clips: durations from a reading pace, scores and rates from the key."""
    i = F.col("doc_id")
    return docs.select(
        i.alias("id"), F.col("source").alias("book"), "text", "lang", (F.col("n_chars").cast("double") / 14.0).alias("dur"),
        (-((i * 37) % 140).cast("double") / 100.0).alias("score"), (-(i * 7 % 17).cast("double")).alias("min_wscore"), (i % 5).cast("int").alias("n_weak"),
        (F.lit(5.0) + (i * 13 % 160).cast("double") / 10.0).alias("char_rate"), F.size(words(F.col("text"))).alias("n_words"), F.col("text").rlike("[0-9]").alias("has_digit"),
    )


def as_flag(c: Column) -> Column:
    """A boolean that may have become the text True."""
    return F.lower(c.cast("string")) == "true"


def reason(min_score: float = -0.95, min_rate: float = 6.0, max_rate: float = 19.0, max_dur: float = 13.0, min_dur: float = 3.5) -> Column:
    """Why a clip is quarantined (the first test that fails), '' if it is kept."""
    return (
        F.when(F.col("score") < min_score, F.format_string("low_score(%.2f)", F.col("score")))
        .when(~F.col("char_rate").between(min_rate, max_rate), F.format_string("char_rate(%.1f)", F.col("char_rate")))
        .when((F.col("dur") > max_dur) | (F.col("dur") < min_dur), F.format_string("duration(%.1f)", F.col("dur")))
        .when(F.col("has_digit"), "has_digit")
        .otherwise("")
    )


def gate(segments: DataFrame, **limits: float) -> DataFrame:
    """segments with reason and keep."""
    return segments.withColumn("reason", reason(**limits)).withColumn("keep", F.col("reason") == "")


def reason_kind(c: Column) -> Column:
    return F.substring_index(c, "(", 1)


def split_kept(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return gated.filter("keep"), gated.filter("not keep")


def book_report(gated: DataFrame) -> DataFrame:
    """By book: clips, kept clips and the seconds of both."""
    return gated.groupBy("book").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"), F.sum("dur").alias("sec"), F.sum(F.when(F.col("keep"), F.col("dur")).otherwise(0.0)).alias("kept_sec"))


def reason_histogram(gated: DataFrame) -> DataFrame:
    return gated.filter("not keep").groupBy(reason_kind(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


def totals(gated: DataFrame) -> DataFrame:
    """One row: clips, kept, quarantined, whole per cent kept."""
    n, k = F.count("*"), F.count_if("keep")
    return gated.agg(n.alias("n"), k.alias("kept"), (n - k).alias("quarantined"), F.floor(k * 100 / F.greatest(n, F.lit(1))).cast("long").alias("kept_pct"))


def tags(lengths: bool = True) -> Column:
    """An array of (tag, weight) of what is suspicious about a clip; lengths adds long and short."""
    each = [
        (F.col("min_wscore") < -11.0, "bad-word!!", 3), ((F.col("min_wscore") < -8.0) & (F.col("min_wscore") >= -11.0), "bad-word", 2),
        (F.col("score") < -0.62, "low-match", 2), ((F.col("n_words") != 0) & (F.col("n_weak") / F.nullif(F.col("n_words"), F.lit(0)) > 0.30), "many-weak", 1),
        (F.col("char_rate") > 15.0, "crammed", 1), (F.col("char_rate") < 7.5, "sparse", 1),
    ]
    if lengths:
        each += [(F.col("dur") > 12.0, "long", 1), (F.col("dur") < 4.0, "short", 1)]
    return F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("tag"), F.lit(weight).alias("weight"))) for test, name, weight in each]))


def suspicion(found: Column, worst: Column) -> Column:
    """The weights' sum, and a tenth of how far the worst word lies below zero."""
    return F.aggregate(found, F.lit(0.0), lambda s, t: s + t["weight"]) + F.greatest(F.lit(0.0), -worst) / 10.0


def audit(kept: DataFrame, lengths: bool = True) -> DataFrame:
    """kept with tags and suspicion."""
    return kept.withColumn("tags", tags(lengths)).withColumn("suspicion", suspicion(F.col("tags"), F.col("min_wscore")))


def suspects(audited: DataFrame) -> DataFrame:
    return audited.filter(F.size("tags") > 0)


def top_suspects(audited: DataFrame, n: int = 40) -> DataFrame:
    """The n most suspicious clips (a report's length), ties by id."""
    return suspects(audited).orderBy(F.desc("suspicion"), "id").limit(n)


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: the value at place n // 2 of each group in order. Ranks by window, so no group is gathered in a row."""
    w = Window.partitionBy(key)
    ranked = df.select(key, value, F.row_number().over(w.orderBy(value)).alias("rn"), F.count("*").over(w).alias("n"))
    return ranked.filter(F.col("rn") == F.floor(F.col("n") / 2) + 1).select(key, F.col(value).alias("median"))


def audit_report(audited: DataFrame) -> DataFrame:
    """By book: clips, suspects, clips with a bad word, mean score, per cent suspects, upper median of the worst word."""
    bad = F.exists("tags", lambda t: t["tag"].startswith("bad-word"))
    by = audited.groupBy("book").agg(
        F.count("*").alias("n"), F.count_if(F.size("tags") > 0).alias("suspects"), F.count_if(bad).alias("bad_words"), F.avg("score").alias("mean_score"),
        (F.count_if(F.size("tags") > 0) * 100.0 / F.count("*")).alias("suspect_pct"),
    )
    return by.join(upper_median(audited, "book", "min_wscore").withColumnRenamed("median", "median_wscore"), "book")


def counts_by_tag(audited: DataFrame) -> DataFrame:
    """One row of counts over all kept clips."""
    one = lambda name: F.count_if(F.exists("tags", lambda t: t["tag"] == name)).alias(name.replace("-", "_").replace("!!", "_worst"))
    return audited.agg(F.count("*").alias("n"), F.count_if(F.size("tags") > 0).alias("suspects"), *map(one, ("bad-word!!", "bad-word", "low-match", "many-weak", "crammed", "sparse")))


def clip_metrics(words_df: DataFrame, key: str = "clip") -> DataFrame:
    """Metrics of clips from their aligned words (text, start, end, score, wscore, real)."""
    span = F.max("end") - F.min("start")
    chars = F.sum(F.length(F.replace("text", F.lit(" "), F.lit(""))))
    return words_df.groupBy(key).agg(
        (F.sum("score") / F.greatest(span * 50, F.lit(1.0))).alias("score"), F.coalesce(F.min(F.when(F.col("real"), F.col("wscore"))), F.lit(0.0)).alias("min_wscore"),
        F.count_if(F.col("wscore") < -2.0).alias("n_weak"), F.when(span > 0, chars / F.nullif(span, F.lit(0.0))).otherwise(0.0).alias("char_rate"),
        F.coalesce(F.max(F.col("text").rlike(r"(?U)\d")), F.lit(False)).alias("has_digit"), F.count("*").alias("n_words"), span.alias("dur"),
    )


def word_scores(words_df: DataFrame) -> DataFrame:
    """words with wscore (score by frame) and real (at least two letters)."""
    return words_df.withColumn("wscore", F.col("score") / F.greatest((F.col("end") - F.col("start")) * 50, F.lit(1.0))).withColumn("real", F.length("romanized") >= 2)


def clip_reject() -> Column:
    """Why a speaker-gated clip is rejected: its peak first, then the similarity; null if it passes."""
    return F.when((F.col("peak") >= 0.999) | (F.col("peak") < 1e-3), "peak").when(F.col("sim") < 0.84, "speaker")


def output_warning(kind: Column, size: Column) -> Column:
    """Whether an output file is suspiciously small (a warning only)."""
    return size < F.when(kind == "video", 500_000).otherwise(5_000)


def grapheme_coverage(lines: DataFrame, text: str = "text", targets: tuple[str, ...] = ("ñ", "q", "ğ", "ç", "ş", "c", "j", "h"), min_rate: float = 0.02) -> DataFrame:
    """By grapheme: occurrences, clips that have it, their share, status. One pass, one row of partial sums a task."""
    low = F.lower(text)
    total = lambda g: F.sum(F.length(low) - F.length(F.replace(low, F.lit(g), F.lit(""))))
    one = lines.agg(F.count("*").alias("n"), *[x for i, g in enumerate(targets) for x in (total(g).alias(f"t{i}"), F.count_if(F.contains(low, F.lit(g))).alias(f"c{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grapheme"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("total"), F.col(f"c{i}").alias("clips")) for i, g in enumerate(targets)]))
    n = F.when(F.col("n") == 0, F.raise_error(F.lit("no input lines")).cast("long")).otherwise(F.col("n"))
    out = one.select(n.alias("n"), each.alias("g")).select("g.*", (F.col("g.clips") / F.col("n")).alias("rate"))
    return out.withColumn("status", F.when(F.col("rate") >= min_rate, "OK").when(F.col("clips") > 0, "LOW").otherwise("MISSING"))


def missing_critical(coverage: DataFrame, critical: tuple[str, ...] = ("ñ", "q", "ğ")) -> DataFrame:
    return coverage.filter(F.col("grapheme").isin(*critical) & (F.col("status") == "MISSING")).select("grapheme")

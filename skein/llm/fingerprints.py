"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

A text's canonical form is NFKC, full case folding, NFKC again, then every run of white space one space, ends trimmed.
Its fingerprint is 128 bits of xxHash64 (two seeds). Texts with the same digest are one class only if their canonical
bytes are equal: inside buckets with several rows the canonical text itself is a grouping key.

Defined results: a null text counts as empty; empty texts share one fingerprint; null keys are kept and come first;
repeated rows are kept, and each gets the class of its text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import maybe_broadcast, parts, range_bucket, staged

#: Bucket keys (16 bytes each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 500_000
_SEED = 0x5F3759DF


def canonical(text: Column) -> Column:
    """NFKC, case folding and NFKC by the ICU classes that Spark ships; plain lower case where all is ASCII."""

    def call(klass: str, method: str, c: Column) -> Column:
        return F.java_method(F.lit(klass), F.lit(method), c, F.lit(True))

    def compose(c: Column) -> Column:
        return call("com.ibm.icu.text.Normalizer", "compose", c)

    text = F.coalesce(text, F.lit(""))
    full = compose(call("com.ibm.icu.lang.UCharacter", "foldCase", compose(text)))
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), full).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> tuple[Column, Column]:
    """Two longs: xxHash64 with the usual seed, and with one made of it and a constant."""
    return F.xxhash64(canon), F.xxhash64(F.lit(_SEED), canon)


def as_hex(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def classes(docs: DataFrame, digests: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digests (key, h1, h2) with class_id (least key with the same canonical bytes) and class_size.

    Only rows in buckets of two or more are compared, by grouping on the digest and the canonical text: copies meet in
    the partial aggregate, so a bucket with a third of all rows sends one row a task.
    """
    several = digests.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    canon = docs.select(F.col(key), canonical(F.col(text)).alias("canon"))
    h1, h2 = digest(F.col("canon"))
    canon = canon.withColumns({"h1": h1, "h2": h2}).join(maybe_broadcast(several, BROADCAST_KEYS), ["h1", "h2"], "left_semi")
    same = canon.groupBy("h1", "h2", "canon").agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"))
    same = staged(same.withColumn("variants", F.count("*").over(Window.partitionBy("h1", "h2"))), "fingerprint-classes")
    plain = digests.join(same.filter("variants = 1").select("h1", "h2", "class_id", "class_size"), ["h1", "h2"], "left")
    clash = same.filter("variants > 1")
    if clash.isEmpty():
        return plain.withColumns({"class_id": F.coalesce("class_id", key), "class_size": F.coalesce("class_size", F.lit(1))})
    # different texts with one digest: their rows take the class of their own text
    apart = canon.join(clash.select("h1", "h2", "canon", F.col("class_id").alias("own_id"), F.col("class_size").alias("own_size")), ["h1", "h2", "canon"]).select(key, "own_id", "own_size").distinct()
    return plain.join(apart, key, "left").withColumns({"class_id": F.coalesce("own_id", "class_id", key), "class_size": F.coalesce("own_size", "class_size", F.lit(1))}).drop("own_id", "own_size")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint, class_id, class_size for each row of docs."""
    h1, h2 = digest(canonical(F.col(text)))
    digests = staged(docs.select(F.col(key), h1.alias("h1"), h2.alias("h2")), "fingerprints")
    return classes(docs, digests, key, text).select(key, as_hex(F.col("h1"), F.col("h2")).alias("fingerprint"), "class_id", "class_size")


def with_next(docs: DataFrame, key: str, columns: list[str], order: Column) -> DataFrame:
    """docs with next_<c> for each of columns: the value in the following row by key (after the last: of the first).

    Rows are dealt into ranges of key; each range also gets the first row of the range after it, so no range needs
    another's rows and none holds more than its share. order breaks ties among equal keys.
    """
    docs = docs.withColumn("bucket", range_bucket(docs, key, 4 * parts(docs)))
    firsts = docs.groupBy("bucket").agg(F.min(key).alias("first_key"))
    # as many rows as there are ranges, whatever the input
    at = Window.orderBy("bucket")
    firsts = firsts.withColumns({"into": F.lag("bucket").over(at), "final": F.max("bucket").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    firsts = firsts.select("bucket", "first_key", F.coalesce("into", "final").alias("into"))
    heads = docs.join(F.broadcast(firsts), "bucket").filter(F.col(key).eqNullSafe(F.col("first_key"))).drop("first_key", "bucket").withColumnRenamed("into", "bucket")
    every = docs.withColumn("extra", F.lit(0)).unionByName(heads.withColumn("extra", F.lit(1)))
    w = Window.partitionBy("bucket").orderBy("extra", F.asc_nulls_first(key), order)
    return every.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("extra = 0").drop("extra", "bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint and that of its edited text (last floor(n/4) code points from the next document)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2 = digest(canonical(F.col("text")))
    follow = with_next(docs.withColumns({"h1": h1, "h2": h2}), "doc_id", ["text", "h1", "h2"], F.col("h1"))
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    # a row alone in the table follows itself
    follow = follow.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - q), F.substring(F.coalesce("next_text", "text"), F.lit(1), q))})
    canon, changed = canonical(F.col("text")), canonical(F.col("edited"))
    follow = follow.withColumns({"canon": canon, "changed": changed})
    e1, e2 = digest(F.col("changed"))
    same = lambda hit: F.when(hit, 1.0).otherwise(0.0)
    next_same = (F.col("h1") == F.coalesce("next_h1", "h1")) & (F.col("h2") == F.coalesce("next_h2", "h2"))
    digests = follow.select(
        "doc_id", "n_chars", "h1", "h2", e1.alias("e1"), e2.alias("e2"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        same(F.col("canon") == F.col("changed")).alias("near_edited"),
        same(F.when(next_same, F.col("canon") == canonical(F.coalesce("next_text", "text"))).otherwise(False)).alias("near_next"),
    )
    digests = staged(digests, "fingerprints")
    return classes(docs, digests).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("h1"), F.col("h2")).alias("fingerprint"), as_hex(F.col("e1"), F.col("e2")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "class_size",
    )

"""Queries of alignment, batches and samples: documents as books that are read aloud, a word after the other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import align, collate, curate
from skein.plans.base import Tables, query
from skein.session import scratch
from skein.sources import files, hub, media

#: Frames a second, sounds, and how many frames each word takes; a pause of 1 to 3 frames follows, by the word's length.
RATE, SOUNDS, SPOKEN = 4, 31, 2
#: Words whose sounds and frames are one row.
LINE = 250
SPACES = r"[ \t\r\n]+"


def spoken(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Words of the documents, and the frames of their reading: the sound of each frame, 0 for a pause; LINE words a row.

    A word sounds by its place, so that no word is taken for its neighbours.
    """
    plain = F.trim(F.regexp_replace("text", SPACES, " "))
    words = t.documents.filter(F.length(plain) > 0).select(F.col("doc_id").alias("book"), F.split(plain, " ").alias("words"))
    cuts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / LINE).cast("int"))
    lines = words.select("book", F.posexplode(F.transform(cuts, lambda k: F.slice("words", k * LINE + 1, LINE)))).select("book", (F.col("pos") * LINE).alias("pos"), F.col("col").alias("words"))
    sound = lambda i: (F.col("pos") + i) % SOUNDS + 1
    said = lines.select("book", F.col("pos").cast("long").alias("pos"), F.transform("words", lambda w, i: sound(i).cast("string")).alias("text"))
    # a reading for each sound and length of the pause after it
    readings = F.array(*(F.array(*map(F.lit, [float(s)] * SPOKEN + [0.0] * pause)).cast("array<float>") for s in range(1, SOUNDS + 1) for pause in (1, 2, 3)))
    frames = F.flatten(F.transform("words", lambda w, i: F.get(readings, (sound(i) - 1) * 3 + F.length(w) % 3)))
    return said, lines.select("book", (F.col("pos") * 8).cast("long").alias("frame"), frames.alias("scores"))


def emit(heard: np.ndarray) -> np.ndarray:
    """Scores of sounds by frame: 0 for the one heard, -8 for others; the filler stands for a pause, and badly for others."""
    sound = heard[:, 0].astype(int)
    out = np.full((len(sound), SOUNDS + 1), -8.0)
    out[np.arange(len(sound)), sound] = 0.0
    out[:, align.FILLER] = np.where(sound == 0, 0.0, -2.0)
    return out


def spell(word: str) -> list[int]:
    return [int(word)]


#: Where each word's last frame ends follows from lengths alone; windows follow from those places, one after the other.
WINDOWS = r"""
WITH RECURSIVE w AS (SELECT doc_id AS book, string_split(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' ') AS w FROM documents WHERE len(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) > 0),
f AS (SELECT book, i - 1 AS pos, 3 + len(w[i]) % 3 AS f FROM (SELECT book, w, UNNEST(range(1, len(w) + 1)) AS i FROM w)),
e AS (SELECT book, pos, CAST(SUM(f) OVER (PARTITION BY book ORDER BY pos) - f + 2 AS BIGINT) AS reached FROM f),
b AS (SELECT book, COUNT(*) AS n, CAST(SUM(f) AS BIGINT) AS total FROM f GROUP BY book),
steps AS (
  SELECT b.book, CAST(0 AS INT) AS "window", CAST(0 AS BIGINT) AS first, CASE WHEN total <= 6800 OR n <= 400 THEN n ELSE 375 END AS committed, CAST(0 AS BIGINT) AS lo, CASE WHEN total <= 6800 OR n <= 400 THEN total ELSE least(total, 2400) END AS hi, e.reached, n, total
  FROM b JOIN e ON e.book = b.book AND e.pos = CASE WHEN total <= 6800 OR n <= 400 THEN n ELSE 375 END - 1
  UNION ALL
  SELECT s.book, s."window" + 1, s.first + s.committed, CASE WHEN s.first + s.committed + 400 >= s.n THEN s.n - s.first - s.committed ELSE 375 END, greatest(0, s.reached - 32),
    CASE WHEN s.first + s.committed + 400 >= s.n THEN s.total ELSE least(s.total, s.reached + 2400) END, e.reached, s.n, s.total
  FROM steps s JOIN e ON e.book = s.book AND e.pos = s.first + s.committed + CASE WHEN s.first + s.committed + 400 >= s.n THEN s.n - s.first - s.committed ELSE 375 END - 1
  WHERE s.first + s.committed < s.n AND s.total - s.reached >= 20)
SELECT book, "window", first, committed, lo / 4.0 AS win_start, hi / 4.0 AS win_end, reached / 4.0 AS reached FROM steps"""


@query(WINDOWS)
def aligned_windows(t: Tables) -> DataFrame:
    """Windows, commits and places reached, from the scores of every frame."""
    return align.align_windows(*spoken(t), spell=spell, rate=RATE, emit=emit, width=1)


#: Batches of 16 documents of like length; a row's cells are the lengths of its words.
BATCHES = r"""
WITH w AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: len(x)) AS ids, n_chars FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, (row_number() OVER (ORDER BY len(ids), doc_id) - 1) // 16 AS batch FROM w),
s AS (SELECT batch, CAST(ceil(max(len(ids)) / 8.0) * 8 AS BIGINT) AS width FROM b GROUP BY batch),
p AS (SELECT batch, width, doc_id, ids, n_chars, list_concat(list_transform(ids, lambda x: x), list_transform(range(width - len(ids)), lambda x: CAST(-1 AS BIGINT))) AS padded FROM b JOIN s USING (batch)),
f AS (SELECT batch, any_value(width) AS width, COUNT(*) AS rows, flatten(list(padded ORDER BY doc_id)) AS cells, list(len(ids) ORDER BY doc_id) AS lengths, list(doc_id ORDER BY doc_id) AS keys, list(n_chars ORDER BY doc_id) AS sizes FROM p GROUP BY batch)
SELECT batch, CAST(rows AS INT) AS rows, CAST(width AS INT) AS width, CAST(list_sum(cells) AS BIGINT) AS total, md5(array_to_string(cells, ',')) AS cells, md5(array_to_string(lengths, ',')) AS lengths, CAST(list_sum(lengths) AS BIGINT) AS own, array_to_string(keys, ',') AS keys, CAST(list_sum(sizes) AS BIGINT) AS chars FROM f"""


@query(BATCHES)
def padded_batches(t: Tables) -> DataFrame:
    """Every cell of every batch by its checksum, the mask by its sum."""
    words = F.filter(F.split(F.regexp_replace("text", SPACES, " "), " "), lambda x: x != "")
    rows = t.documents.filter("text is not null").select("doc_id", F.transform(words, F.length).alias("ids"), "n_chars").withColumn("n", F.size("ids"))
    got = collate.collate(curate.length_batches(rows, "n", "doc_id", 16), "batch", "doc_id", [collate.Ragged("ids", fill=-1, multiple=8)], ("n_chars",))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return got.select(
        F.col("batch").cast("long").alias("batch"), "rows", F.col("ids_width").alias("width"), total("ids").alias("total"), F.md5(joined("ids")).alias("cells"), F.md5(joined("ids_lengths")).alias("lengths"),
        total("ids_mask").alias("own"), joined("keys").alias("keys"), total("n_chars").alias("chars"),
    )


@query("SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 3 THEN 'test' ELSE 'train' END AS split FROM documents")
def hub_split(t: Tables) -> DataFrame:
    """Documents laid out as a dataset of two splits, each read by its name."""
    at = scratch(t.spark)
    split = F.when(F.col("doc_id") % 10 == 3, "test").otherwise("train")
    for name in ("test", "train"):
        t.documents.filter(split == name).write.parquet(f"{at}/corpus/all/{name}")
    read = lambda name: hub.load(t.spark, at, "corpus", name, "all", columns=["doc_id", "n_chars"], required=["text"]).withColumn("split", F.lit(name))
    return read("test").unionByName(read("train"))


@query("SELECT CAST(vec_id AS VARCHAR) AS name, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings")
def vector_files(t: Tables) -> DataFrame:
    """A npy file for each vector, read back."""
    at = f"{scratch(t.spark)}/vectors"
    media.write_vectors(t.embeddings, at, "vec_id", "embedding")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return media.read_vectors(t.spark, at).select("name", F.size("values").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS name, count(*) * len(any_value(text)) / 8000.0::DOUBLE AS seconds, CAST(128000 AS BIGINT) AS bits_per_second FROM conversations GROUP BY conv_id, turn")
def sound_probe(t: Tables) -> DataFrame:
    """A wave for each turn, a sample for each letter; its length by its header."""
    at = f"{scratch(t.spark)}/sounds"
    sample = F.transform(F.split("text", ""), lambda c: (F.ascii(c) % 64).cast("double") / 64)
    turns = t.conversations.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("name"), F.when(F.length("text") > 0, sample).otherwise(F.array().cast("array<double>")).alias("samples"))
    media.write_vectors(turns, at, "name", "samples", kind="wav", rate=8000)
    got = media.probe(files.listing(t.spark, at, (".wav",)))
    return got.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), "seconds", "bits_per_second")

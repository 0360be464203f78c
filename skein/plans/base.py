"""How queries are registered: a function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.session import share_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            share_path(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Documents in the shape of clips, as operators.qc.clips makes them.
CLIPS = r"""
WITH clips AS (
  SELECT doc_id AS id, source AS book, text, lang, CAST(n_chars AS DOUBLE) / 14.0::DOUBLE AS dur,
         -CAST((doc_id * 37) % 140 AS DOUBLE) / 100.0::DOUBLE AS score, -CAST(doc_id * 7 % 17 AS DOUBLE) AS min_wscore,
         CAST(doc_id % 5 AS INT) AS n_weak, 5.0::DOUBLE + CAST(doc_id * 13 % 160 AS DOUBLE) / 10.0::DOUBLE AS char_rate,
         CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS n_words,
         regexp_matches(text, '[0-9]') AS has_digit
  FROM documents),
gated AS (
  SELECT *, CASE WHEN score < -0.95::DOUBLE THEN 'low_score' WHEN char_rate < 6 OR char_rate > 19 THEN 'char_rate'
                 WHEN dur > 300 OR dur < 3.5::DOUBLE THEN 'duration' WHEN has_digit THEN 'has_digit' ELSE '' END AS reason
  FROM clips),
tagged AS (
  SELECT id, unnest([{'tag': 'bad-word!!', 'weight': 3, 'on': min_wscore < -11}, {'tag': 'bad-word', 'weight': 2, 'on': min_wscore < -8 AND min_wscore >= -11},
    {'tag': 'low-match', 'weight': 2, 'on': score < -0.62::DOUBLE}, {'tag': 'many-weak', 'weight': 1, 'on': n_words <> 0 AND n_weak / n_words::DOUBLE > 0.30::DOUBLE},
    {'tag': 'crammed', 'weight': 1, 'on': char_rate > 15}, {'tag': 'sparse', 'weight': 1, 'on': char_rate < 7.5::DOUBLE},
    {'tag': 'long', 'weight': 1, 'on': dur > 12}, {'tag': 'short', 'weight': 1, 'on': dur < 4}]) AS t
  FROM gated WHERE reason = ''),
tags AS (SELECT id, t.tag AS tag, t.weight AS weight FROM tagged WHERE t.on),
audited AS (
  SELECT g.*, coalesce(w, 0) AS weights, coalesce(w, 0) + greatest(0.0::DOUBLE, -min_wscore) / 10.0::DOUBLE AS suspicion, coalesce(bad, FALSE) AS bad
  FROM gated g LEFT JOIN (SELECT id, CAST(sum(weight) AS DOUBLE) AS w, bool_or(tag LIKE 'bad-word%') AS bad FROM tags GROUP BY id) USING (id) WHERE reason = '')
"""

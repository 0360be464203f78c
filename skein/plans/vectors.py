"""Queries of vectors, metrics and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import loudness, models
from skein.plans.base import Tables, query

UNITS = """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda w: w * w)))) AS u FROM x),
m AS (SELECT label, i, avg(u[i]) AS x FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY label),
n AS (SELECT label, list_transform(m, lambda v: v / sqrt(list_sum(list_transform(m, lambda w: w * w)))) AS c FROM c)
"""


def centroids(t: Tables) -> DataFrame:
    units = t.embeddings.select("vec_id", "label", V.unit(F.col("embedding")).alias("u"))
    return models.mean_vectors(units, "label", "u").select("label", V.unit(F.col("mean")).alias("centroid"))


@query(UNITS + "SELECT vec_id, round(list_dot_product(u, c), 6) AS sim FROM u JOIN n USING (label) WHERE list_dot_product(u, c) >= 0.1::DOUBLE")
def centroid_gate(t: Tables) -> DataFrame:
    return models.cosine_gate(t.embeddings, centroids(t), "label", "embedding", 0.1).select("vec_id", F.round("sim", 6).alias("sim"))


@query(UNITS + "SELECT a.label AS a, b.label AS b, round(list_dot_product(a.c, b.c), 6) AS sim FROM n a, n b WHERE a.label <> b.label")
def label_similarity(t: Tables) -> DataFrame:
    return models.group_similarity(centroids(t), "label", "centroid").withColumn("sim", F.round("sim", 6))


@query(UNITS + "SELECT round(min(list_dot_product(a.c, b.c)), 6) AS least, round(avg(list_dot_product(a.c, b.c)), 6) AS mean, min(list_dot_product(a.c, b.c)) > 0.8::DOUBLE AS one_reader FROM n a, n b WHERE a.label <> b.label")
def one_reader(t: Tables) -> DataFrame:
    return models.one_reader(models.group_similarity(centroids(t), "label", "centroid")).select(F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), "one_reader")


@query()
def trimmed_centroid(t: Tables) -> DataFrame:
    out = models.trimmed_centroid(t.embeddings, "label", "embedding", 0.3)
    return out.select("label", "kept", "total", F.round(V.norm(F.col("centroid")), 6).alias("norm"))


@query("SELECT vec_id, round(list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))), 6) AS peak, round(list_max(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 0.95::DOUBLE / list_max(list_transform(embedding, lambda w: abs(CAST(w AS DOUBLE)))))), 6) AS top FROM embeddings")
def peak_normal(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(V.peak(e), 6).alias("peak"), F.round(F.array_max(V.peak_normalise(e)), 6).alias("top"))


@query("SELECT p_partkey, round((p_retailprice - m) / (s + 0.000001::DOUBLE), 6) AS z FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part WHERE p_partkey % 4 <> 0)")
def zscore(t: Tables) -> DataFrame:
    train = t.part.filter("p_partkey % 4 != 0")
    return models.zscore(train, t.part.select("p_partkey", "p_retailprice"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice", 6).alias("z"))


@query("SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS \"index\" FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def class_index(t: Tables) -> DataFrame:
    return models.class_index(t.customer.filter("c_custkey % 2 = 0"), t.customer.filter("c_custkey % 2 = 1"), label="c_mktsegment")


@query("SELECT p_brand, round(sqrt(avg(power(p_size * 30.0::DOUBLE - p_retailprice, 2))), 6) AS rmse FROM part GROUP BY p_brand")
def rmse(t: Tables) -> DataFrame:
    return models.rmse(t.part, ["p_brand"], F.col("p_size") * 30.0, F.col("p_retailprice")).withColumn("rmse", F.round("rmse", 6))


@query("SELECT c_mktsegment, round(avg(CASE WHEN c_nationkey % 2 = c_custkey % 2 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM customer GROUP BY c_mktsegment")
def accuracy(t: Tables) -> DataFrame:
    return models.accuracy(t.customer, ["c_mktsegment"], F.col("c_nationkey") % 2, F.col("c_custkey") % 2).withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT event_type, coalesce(CAST(min(event_id) FILTER (day(ts) = 1) AS VARCHAR), '—') AS d1, coalesce(CAST(min(event_id) FILTER (day(ts) = 2) AS VARCHAR), '—') AS d2, coalesce(CAST(min(event_id) FILTER (day(ts) = 31) AS VARCHAR), '—') AS d31 FROM events GROUP BY event_type""")
def pivot_grid(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.concat(F.lit("d"), F.dayofmonth("ts").cast("string")).alias("day"), "event_id")
    return models.pivot_grid(rows, "event_type", "day", "event_id", ["d1", "d2", "d31"])


@query("SELECT l_returnflag, round(sum(CASE WHEN l_discount < 0.05::DOUBLE THEN l_quantity ELSE 0 END) * 100.0 / sum(l_quantity), 6) AS retention_pct FROM lineitem GROUP BY l_returnflag")
def slice_retention(t: Tables) -> DataFrame:
    return models.retention(t.lineitem, "l_returnflag", F.col("l_discount") < 0.05, "l_quantity").withColumn("retention_pct", F.round("retention_pct", 6))


@query("""WITH v AS (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
f AS (SELECT vec_id, n, i, (CAST(floor(CAST(x AS DOUBLE) * 1e9::DOUBLE) AS BIGINT) % 4294967296 + 4294967296) % 4294967296 AS b FROM v),
p AS (SELECT a.vec_id, a.n AS na, c.n AS nb, a.i - c.i AS shift, bit_count(xor(a.b, c.b)) AS bits FROM f a JOIN f c ON c.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, shift, sum(bits) / (count(*) * 32.0::DOUBLE) AS share FROM p
WHERE abs(shift) <= least(120, least(na, nb) // 2) AND (shift + least(120, least(na, nb) // 2)) % 2 = 0 GROUP BY vec_id, shift HAVING count(*) >= 40)
SELECT e.vec_id, round(coalesce((SELECT min(share) FROM s WHERE s.vec_id = e.vec_id), 1), 6) AS bit_error FROM embeddings e SEMI JOIN embeddings o ON o.vec_id = e.vec_id + 1""")
def bit_errors(t: Tables) -> DataFrame:
    """Fingerprints of 64 values, those of each vector and the next one, compared over shifts."""
    fp = F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * 1e9), F.lit(1 << 32)).cast("long"))
    rows = t.embeddings.select("vec_id", fp.alias("fp"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fp").alias("next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(V.bit_error(F.col("fp"), F.col("next")), 6).alias("bit_error"))


@query("""WITH v AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
x AS (SELECT label, CAST(x AS DOUBLE) / pow(10.0::DOUBLE, vec_id // 60 % 5) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS place FROM v),
h AS (SELECT label, place // 40 AS hop, count(*) AS n, sum(x * x) AS squares, max(abs(x)) AS peak FROM x GROUP BY 1, 2),
b AS (SELECT a.label, a.hop, sum(o.squares) / 160 AS power FROM h a JOIN h o ON o.label = a.label AND o.hop BETWEEN a.hop AND a.hop + 3 GROUP BY a.label, a.hop HAVING sum(o.n) = 160),
f AS (SELECT * FROM b WHERE -0.691::DOUBLE + 10 * log10(nullif(power, 0)) > -70),
g AS (SELECT label, power FROM f JOIN (SELECT label, avg(power) AS mean FROM f GROUP BY label) USING (label) WHERE power > mean / 10),
l AS (SELECT label, -0.691::DOUBLE + 10 * log10(avg(power)) AS loudness, count(*) AS blocks FROM g GROUP BY label)
SELECT label, round(loudness, 6) AS loudness, coalesce(blocks, 0) AS blocks, round(peak, 6) AS peak FROM (SELECT label, max(peak) AS peak FROM h GROUP BY label) LEFT JOIN l USING (label)""")
def gated_loudness(t: Tables) -> DataFrame:
    """The vectors of a label, end to end and some of them softer, as a sound of 400 samples a second; blocks and gates
    as for recordings, without the weighting, which SQL can't follow."""
    softer = F.pow(F.lit(10.0), F.floor(F.col("vec_id") / 60) % 5)
    rows = t.embeddings.select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") / softer).alias("x"))
    out = loudness.loudness(rows, "label", "vec_id", "x", 400, weigh=False)
    return out.select("label", F.round("loudness", 6).alias("loudness"), "blocks", F.round("peak", 6).alias("peak"))

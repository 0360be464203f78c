"""Queries of joins, ordered operators and set operations over the star tables, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import curate, joins, match, models, segments
from skein.plans.base import Tables, query

BAND = 0.5
BAND_SQL = """WITH p AS (SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key, abs(a.o_totalprice - b.o_totalprice) AS delta FROM orders a JOIN orders b ON abs(a.o_totalprice - b.o_totalprice) <= 0.5::DOUBLE AND a.o_orderkey < b.o_orderkey) """


def band(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("left_key"), F.col("o_totalprice").alias("left_price"))
    b = t.orders.select(F.col("o_orderkey").alias("right_key"), F.col("o_totalprice").alias("right_price"))
    pairs = joins.band_join(a, b, "left_price", "right_price", BAND).filter("left_key < right_key")
    return pairs.select("left_key", "right_key", F.abs(F.col("left_price") - F.col("right_price")).alias("delta"))


@query(BAND_SQL + "SELECT left_key, right_key, round(delta, 6) AS delta FROM p")
def band_pairs(t: Tables) -> DataFrame:
    return band(t).withColumn("delta", F.round("delta", 6))


@query(BAND_SQL + "SELECT left_key, right_key FROM (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY delta, right_key) AS rn FROM p) WHERE rn = 1")
def band_best(t: Tables) -> DataFrame:
    return joins.best_partner(band(t), "left_key", ["delta", "right_key"]).select("left_key", "right_key")


@query(BAND_SQL + "SELECT left_key, right_key, CASE WHEN (left_key + right_key) % 10 / 20.0::DOUBLE <= 0.25::DOUBLE THEN 'duplicate' ELSE 'same-length' END AS class FROM p WHERE (left_key + right_key) % 10 / 20.0::DOUBLE <= 0.25::DOUBLE OR delta <= 0.3::DOUBLE")
def band_class(t: Tables) -> DataFrame:
    error = (F.col("left_key") + F.col("right_key")) % 10 / 20.0
    return joins.classify_pairs(band(t).withColumn("bit_error", error), most_delta=0.3).select("left_key", "right_key", "class")


@query(BAND_SQL + """, e AS (SELECT *, (left_key + right_key) % 10 / 20.0::DOUBLE AS error FROM p)
SELECT 'duplicate' AS class, left_key, right_key FROM e WHERE error <= 0.25::DOUBLE
UNION ALL SELECT * FROM (SELECT 'same-length', left_key, right_key FROM e WHERE error > 0.25::DOUBLE AND delta <= 0.3::DOUBLE ORDER BY delta, left_key, right_key LIMIT 40)""")
def pair_lists(t: Tables) -> DataFrame:
    """The two lists of a dedup report: all duplicates, the first 40 pairs of like length (a top list is what it is for)."""
    pairs = band(t).withColumn("bit_error", (F.col("left_key") + F.col("right_key")) % 10 / 20.0)
    double, same = joins.pair_lists(joins.classify_pairs(pairs, most_delta=0.3), ["left_key", "right_key"])
    return double.select("class", "left_key", "right_key").unionAll(same.select("class", "left_key", "right_key"))


@query("SELECT e AS epoch, (SELECT min(p_name) FROM part WHERE p_size = e) AS path FROM (SELECT unnest([1, 10, 50, 999]) AS e)")
def chosen_checkpoints(t: Tables) -> DataFrame:
    return curate.chosen_checkpoints(t.part.select(F.col("p_size").alias("epoch"), F.col("p_name").alias("path")), [1, 10, 50, 999])


@query("SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type FROM events")
def distinct_counts(t: Tables) -> DataFrame:
    return curate.distinct_counts(t.events, ["user_id", "event_type"])


@query(BAND_SQL + "SELECT (SELECT count(DISTINCT left_key) FROM p) AS pairs, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT left_key FROM p)) AS left_only")
def unique_counts(t: Tables) -> DataFrame:
    keys = t.orders.select(F.col("o_orderkey").alias("left_key"))
    return joins.unique_counts(keys, keys.withColumnRenamed("left_key", "right_key"), band(t), "left_key", "right_key").select("pairs", "left_only")


@query("""WITH media AS (SELECT DISTINCT o_custkey AS k, c_acctbal AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 50000)
SELECT c_custkey, (SELECT count(*) FROM media WHERE abs(v - c_acctbal) <= 5) AS near FROM customer WHERE c_custkey NOT IN (SELECT k FROM media)""")
def orphans(t: Tables) -> DataFrame:
    """Customers without a small urgent order, and how many of those with one have a like balance."""
    small = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice < 50000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    media = small.join(t.customer.select("c_custkey", F.col("c_acctbal").alias("v")), "c_custkey")
    return joins.orphans(t.customer.select("c_custkey", "c_acctbal"), media, "c_custkey", "c_acctbal", "v", 5.0).select("c_custkey", "near")


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 4)) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 4)) AS w FROM documents),
s AS (SELECT item_id, doc_id, round(len(list_intersect(b.w, d.w)) / len(b.w)::DOUBLE, 9) AS score FROM b, d WHERE len(b.w) > 0)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0) WHERE rn <= 3""")
def topk_candidates(t: Tables) -> DataFrame:
    """The three documents that hold most of an item's words: through an inverted list, not all pairs."""
    bag = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= 4))
    items = t.benchmark.select("item_id", bag("text").alias("w")).filter(F.size("w") > 0).select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    docs = t.documents.select("doc_id", F.explode(bag("text")).alias("word"))
    score = docs.join(items, "word").groupBy("item_id", "doc_id").agg((F.count("*") / F.max("n")).alias("score")).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return score.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@query("SELECT item_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def phrase_contains(t: Tables) -> DataFrame:
    """How many documents hold an item's whole text: by its longest inner word, then by the text itself."""
    inner = F.slice(F.split("text", r"\s+"), F.lit(2), F.greatest(F.size(F.split("text", r"\s+")) - 2, F.lit(0)))
    by_length = F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    items = t.benchmark.select("item_id", F.col("text").alias("phrase"), F.get(by_length, F.lit(0))["w"].alias("word"))
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    keys = items.filter("word is not null").select("item_id", "word")
    few = keys.limit(match.BROADCAST_BOOKS + 1).count() <= match.BROADCAST_BOOKS
    near = words.join(F.broadcast(keys) if few else keys, "word").select("doc_id", "item_id")
    found = near.join(items.select("item_id", "phrase"), "item_id").join(t.documents.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("phrase")))
    # items of one or two words have no inner word: the few there may be are searched as they are
    short = items.filter("word is null and phrase is not null")
    plain = t.documents.select("doc_id", "text").join(short.select("item_id", "phrase"), F.contains("text", F.col("phrase"))) if not short.isEmpty() else None
    every = found.select("item_id") if plain is None else found.select("item_id").unionAll(plain.select("item_id"))
    return every.groupBy("item_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / 32) AS BIGINT) AS batch FROM documents")
def length_batches(t: Tables) -> DataFrame:
    return curate.length_batches(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 32).select("doc_id", "batch")


@query("SELECT source, round(sum(n_chars) / 60.0, 6) AS minutes FROM documents GROUP BY source")
def group_minutes(t: Tables) -> DataFrame:
    return curate.group_minutes(t.documents, "source", "n_chars").select("source", F.round("minutes", 6).alias("minutes"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING), 6) AS l_quantity_sum FROM lineitem")
def running_sums(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("step", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    return models.running_sums(rows, "l_orderkey", "step", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity_sum", 6).alias("l_quantity_sum"))


@query("SELECT doc_id, n_chars / 14.0::DOUBLE BETWEEN 4 AND 9 AND 1 - (doc_id % 20) / 100.0::DOUBLE >= 0.90::DOUBLE AS chosen FROM documents")
def eligible(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", curate.eligible(1 - (F.col("doc_id") % 20) / 100.0, F.col("n_chars") / 14.0).alias("chosen"))


@query("""SELECT conv_id, count(*) AS parts, max(length(text)) AS best, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id""")
def work_collapse(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("score", F.length("text"))
    return match.collapse_works(rows, "conv_id", "score", "turn").select("conv_id", "parts", F.col("best").cast("long").alias("best"), F.col("first.role").alias("role"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS files, count(*) AS parts, round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY o_custkey")
def group_files(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("file"), "o_totalprice")
    return match.group_files(rows, ["o_custkey"], "pos", "file", "o_totalprice").select("o_custkey", F.array_join("files", ",").alias("files"), "parts", F.round("seconds", 2).alias("seconds"))


EVENT_TIMES = "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, epoch_us(ts) / 1000000.0::DOUBLE + value / 10.0::DOUBLE AS f FROM events) "


def timed(t: Tables) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select("event_id", "user_id", s.alias("start"), (s + F.col("value") / 10.0).alias("end"))


@query(EVENT_TIMES + "SELECT event_id, round(coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) - f, 1e9::DOUBLE), 3) AS gap FROM e")
def gaps_lead(t: Tables) -> DataFrame:
    rows = timed(t).withColumn("pos", F.struct("start", "event_id"))
    return segments.gaps(rows, "user_id", "pos").select("event_id", F.round("gap", 3).alias("gap"))


@query(EVENT_TIMES + """, n AS (SELECT *, lag(f) OVER w AS before, lead(s) OVER w AS after FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT event_id, round(CASE WHEN before IS NULL THEN greatest(s - 0.06::DOUBLE, 0) ELSE greatest(s - least(greatest((s - before) / 2, 0.06::DOUBLE), 0.30::DOUBLE), 0) END, 3) AS cut_start,
  round(CASE WHEN after IS NULL THEN f + 0.06::DOUBLE ELSE f + least(greatest((after - f) / 2, 0.06::DOUBLE), 0.30::DOUBLE) END, 3) AS cut_end FROM n""")
def cut_bounds(t: Tables) -> DataFrame:
    rows = timed(t).withColumn("pos", F.struct("start", "event_id"))
    return segments.cut_bounds(rows, "user_id", "pos").select("event_id", F.round("cut_start", 3).alias("cut_start"), F.round("cut_end", 3).alias("cut_end"))


@query(EVENT_TIMES + """, l AS (SELECT *, CASE WHEN s - lag(s) OVER w >= 3600 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l)
SELECT user_id, round(min(s), 3) AS "start", round(max(s), 3) AS "end", count(*) AS parts FROM i GROUP BY user_id, island""")
def merge_close(t: Tables) -> DataFrame:
    rows = timed(t).select("user_id", "start", F.col("start").alias("end"))
    out = segments.merge_close(rows, "user_id", "start", "end", 3600.0)
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "parts")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS s, CAST(l_linenumber AS DOUBLE) + l_quantity AS f FROM lineitem),
c AS (SELECT *, unnest(generate_series(0, CAST(greatest(ceil((f - s) / 10.0::DOUBLE) - 1, 0) AS INT))) AS chunk FROM i WHERE f - s >= 3.5::DOUBLE)
SELECT l_orderkey, l_linenumber, s + chunk * 10 AS chunk_start, least(s + chunk * 10 + 10, f) AS chunk_end FROM c WHERE least(s + chunk * 10 + 10, f) - (s + chunk * 10) >= 3.5::DOUBLE""")
def interval_chunks(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("s"), (F.col("l_linenumber").cast("double") + F.col("l_quantity")).alias("f"))
    return segments.chunk_intervals(rows, "s", "f", 3.5, 10.0).select("l_orderkey", "l_linenumber", "chunk_start", "chunk_end")


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bound FROM conversations")
def cumulative_bounds(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return segments.running_total(rows, "conv_id", "turn", "n", "bound").select("conv_id", "turn", "bound")


@query(r"""SELECT conv_id, turn, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS last_word FROM
(SELECT conv_id, turn, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS n FROM conversations)""")
def sentence_ends(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.size(X.words(F.col("text"))).alias("n"))
    return segments.sentence_ends(rows, "conv_id", "turn", "n").select("conv_id", "turn", F.col("last_word").cast("long").alias("last_word"))


@query("SELECT role, round(sum(length(text)) / sum(length(text) / 14.0::DOUBLE + turn), 9) AS chars_per_sec FROM conversations GROUP BY role")
def reading_rates(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.conversations.groupBy("role").agg(F.round(F.sum(n) / F.sum(n / 14.0 + F.col("turn")), 9).alias("chars_per_sec"))


@query("SELECT p_brand, arg_max(p_name, {'a': p_retailprice, 'b': p_name}) AS p_name, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand")
def largest_per_group(t: Tables) -> DataFrame:
    return curate.largest_per_group(t.part, "p_brand", "p_name", "p_retailprice")


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS INT) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def nested_verdicts(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    out = joins.nested(t.orders.select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_quantity"], "lines")
    return out.select("o_orderkey", F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


@query("""WITH m AS (SELECT year(o_orderdate) AS y, o_orderstatus || '-' || o_orderpriority AS key, count(*) AS value FROM orders GROUP BY ALL),
a AS (SELECT key, value FROM m WHERE y = 1995), b AS (SELECT key, value FROM m WHERE y = 1996)
SELECT coalesce(a.key, b.key) AS key, a.value AS a, b.value AS b, CAST(b.value - a.value AS DOUBLE) AS delta, CASE WHEN b.value > a.value THEN '↑' WHEN b.value < a.value THEN '↓' WHEN b.value = a.value THEN '=' END AS arrow FROM a FULL JOIN b ON a.key = b.key""")
def metrics_full_outer(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("key")).agg(F.count("*").alias("value"))
    return joins.metric_diff(m.filter("y = 1995").select("key", "value"), m.filter("y = 1996").select("key", "value"))


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'none') AS n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_default(t: Tables) -> DataFrame:
    return joins.lookup(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation, "n_nationkey", "n_name", "none").select("s_suppkey", "s_name", "n_name")


@query("SELECT c_custkey, CAST(rank AS INT) AS speaker_index FROM customer JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS rank FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment)")
def speaker_index(t: Tables) -> DataFrame:
    return joins.speaker_index(t.customer, "c_mktsegment").select("c_custkey", "speaker_index")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_missing(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return curate.resume(t.customer.select("c_custkey"), done, "c_custkey")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, p_brand FROM part")
def union_sources(t: Tables) -> DataFrame:
    one = lambda df, kind, i, n: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name"))
    part = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return match.union_sources(one(t.customer, "customer", "c_custkey", "c_name"), one(t.supplier, "supplier", "s_suppkey", "s_name"), part)


@query("SELECT key FROM (SELECT DISTINCT c_nationkey AS key FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier)")
def key_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("key")).unionAll(t.supplier.select("s_nationkey")).distinct()


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT s_suppkey FROM supplier")
def key_minus(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key")).distinct().join(t.supplier.select(F.col("s_suppkey").alias("key")), "key", "left_anti")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 200 AND n_chars < 5000")
def length_between(t: Tables) -> DataFrame:
    return curate.length_between(t.documents.select("doc_id", "n_chars"), F.col("n_chars"), 200, 5000)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r > 4")
def rotate_checkpoints(t: Tables) -> DataFrame:
    return curate.rotate(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)


@query("""WITH w AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS whole FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, turn, whole, length(whole) AS n, CAST(length(text) AS DOUBLE) AS secs FROM conversations JOIN w USING (conv_id)),
c AS (SELECT *, CAST(floor(n * sum(secs) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) / nullif(sum(secs) OVER (PARTITION BY conv_id), 0)) AS BIGINT) AS mark FROM p),
a AS (SELECT *, greatest(mark - 400, 0) AS low, substr(whole, greatest(mark - 400, 0) + 1, mark + 400 - greatest(mark - 400, 0)) AS around FROM c),
b AS (SELECT *, length(around) - strpos(reverse(around), chr(10) || chr(10)) - 1 AS place, contains(around, chr(10) || chr(10)) AS found FROM a),
h AS (SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 THEN n WHEN found AND place > 0 THEN low + place ELSE mark END AS hi FROM b)
SELECT conv_id, turn, coalesce(lag(hi) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS lo, hi FROM h""")
def text_bounds(t: Tables) -> DataFrame:
    """Each conversation's whole text cut for its turns by their share of the words."""
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("whole"))
    parts = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("secs")).join(whole, "conv_id")
    return segments.text_bounds(parts, "conv_id", "turn", "secs", "whole").select("conv_id", "turn", "lo", "hi")


@query()
def pack_segments(t: Tables) -> DataFrame:
    """Words of the conversations, half a second each and a pause after every tenth, packed into clips."""
    words = t.conversations.select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("i", "w"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")) - 1
    words = words.withColumn("pos", pos).withColumn("start", F.col("pos") * 0.5 + F.floor(F.col("pos") / 10) * 0.2)
    words = words.withColumns({"end": F.col("start") + 0.5, "sentence_end": F.col("w").rlike("[.!?…]$")})
    return segments.pack_segments(words, "conv_id")


@query()
def fuzzy_candidates(t: Tables) -> DataFrame:
    """Pages as recordings by their whole titles, benchmark items as books by the words of their whole texts."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    recordings = t.pages.select(F.col("page_id").alias("id"), F.lit("").alias("author"), title.alias("work"))
    books = t.benchmark.select(F.col("item_id").cast("string").alias("path"), X.tokens(F.col("text")).alias("tokens"))
    return match.candidates(recordings, books, blocked=True).select("id", "path", F.round("score", 6).alias("score"), "tier")


@query()
def verified_matches(t: Tables) -> DataFrame:
    """Which benchmark items are said by the documents that hold most of their words."""
    works = t.benchmark.select("item_id", F.col("text").alias("work"))
    m = topk_candidates(t).join(works, "item_id").select(F.col("item_id").alias("id"), "work", F.col("doc_id").cast("string").alias("book"))
    books = t.documents.select(F.col("doc_id").cast("string").alias("book"), "text")
    return match.verify(m, books)

"""Queries over clips: gate, audit, reports, dedup, splits, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import curate, match, qc
from skein.plans.base import CLIPS, Tables, query

#: Documents are longer than clips, so the gate's ceiling is raised.
CEILING = 300.0


def gated(t: Tables) -> DataFrame:
    return qc.gate(qc.clips(t.documents), max_dur=CEILING)


def audited(t: Tables) -> DataFrame:
    return qc.audit(qc.split_kept(gated(t))[0])


@query(CLIPS + "SELECT id, reason, reason = '' AS keep FROM gated")
def qc_gate(t: Tables) -> DataFrame:
    return gated(t).select("id", qc.reason_kind(F.col("reason")).alias("reason"), "keep")


@query(CLIPS + "SELECT book, count(*) AS n, count(*) FILTER (reason = '') AS kept, round(sum(dur), 4) AS sec, round(coalesce(sum(dur) FILTER (reason = ''), 0), 4) AS kept_sec FROM gated GROUP BY book")
def qc_book_report(t: Tables) -> DataFrame:
    return qc.book_report(gated(t)).select("book", "n", "kept", F.round("sec", 4).alias("sec"), F.round("kept_sec", 4).alias("kept_sec"))


@query(CLIPS + "SELECT reason, count(*) AS n FROM gated WHERE reason <> '' GROUP BY reason")
def qc_reasons(t: Tables) -> DataFrame:
    return qc.reason_histogram(gated(t))


@query(CLIPS + "SELECT count(*) AS n, count(*) FILTER (reason = '') AS kept, count(*) FILTER (reason <> '') AS quarantined, CAST(floor(count(*) FILTER (reason = '') * 100 / greatest(count(*), 1)) AS BIGINT) AS kept_pct FROM gated")
def qc_totals(t: Tables) -> DataFrame:
    return qc.totals(gated(t))


@query(CLIPS + "SELECT * FROM tags")
def audit_tags(t: Tables) -> DataFrame:
    return audited(t).select("id", F.explode("tags").alias("t")).select("id", "t.*")


@query(CLIPS + "SELECT id, round(suspicion, 6) AS suspicion FROM audited WHERE weights > 0 ORDER BY suspicion DESC, id LIMIT 40")
def audit_top40(t: Tables) -> DataFrame:
    return qc.top_suspects(audited(t)).select("id", F.round("suspicion", 6).alias("suspicion"))


@query(CLIPS + """SELECT book, count(*) AS n, count(*) FILTER (weights > 0) AS suspects, count(*) FILTER (bad) AS bad_words, round(avg(score), 6) AS mean_score,
  round(100.0 * count(*) FILTER (weights > 0) / count(*), 6) AS suspect_pct, list_sort(list(min_wscore))[count(*) // 2 + 1] AS median_wscore FROM audited GROUP BY book""")
def audit_book_median(t: Tables) -> DataFrame:
    return qc.audit_report(audited(t)).withColumns({c: F.round(c, 6) for c in ("mean_score", "suspect_pct")})


@query(CLIPS + """SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM tags t WHERE t.id = a.id)) AS suspects, count(*) FILTER (min_wscore < -11) AS bad_word_worst,
  count(*) FILTER (min_wscore < -8 AND min_wscore >= -11) AS bad_word, count(*) FILTER (score < -0.62::DOUBLE) AS low_match, count(*) FILTER (n_words <> 0 AND n_weak / n_words::DOUBLE > 0.30::DOUBLE) AS many_weak,
  count(*) FILTER (char_rate > 15) AS crammed, count(*) FILTER (char_rate < 7.5::DOUBLE) AS sparse FROM audited a""")
def audit_counts(t: Tables) -> DataFrame:
    return qc.counts_by_tag(audited(t))


@query(CLIPS + "SELECT id, CAST(sum(weight) AS DOUBLE) AS weights FROM tags WHERE tag NOT IN ('long', 'short') GROUP BY id")
def audit_form_tags(t: Tables) -> DataFrame:
    kept = qc.split_kept(gated(t))[0]
    return qc.suspects(qc.audit(kept, lengths=False)).select("id", F.aggregate("tags", F.lit(0.0), lambda s, x: s + x["weight"]).alias("weights"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'untouched' WHEN toxic = 1 OR quality = 0 THEN 'reject' WHEN n_chars >= 200 THEN 'promote' ELSE 'short' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def verdict_coverage(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    out = F.when(F.col("quality").isNull(), "untouched").when((F.col("toxic") == 1) | (F.col("quality") == 0), "reject").when(F.col("n_chars") >= 200, "promote").otherwise("short")
    return j.select("doc_id", out.alias("outcome"))


@query("SELECT count(*) AS total, count(l.doc_id) AS judged, count(*) FILTER (l.quality = 1) AS good FROM documents d LEFT JOIN labels l USING (doc_id)")
def review_counts(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count("quality").alias("judged"), F.count_if(F.col("quality") == 1).alias("good"))


KEYED = """WITH k AS (SELECT doc_id, source, CAST(replace(source, 'src', '') AS INT) AS rank, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS key FROM documents),
first AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, doc_id) AS rn FROM k WHERE key <> '')
"""


def keyed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", F.replace("source", F.lit("src"), F.lit("")).cast("int").alias("rank"), F.regexp_replace(F.lower("text"), "[^0-9a-z]", "").alias("key"), "n_chars")


@query(KEYED + "SELECT doc_id, source FROM first WHERE rn = 1 UNION ALL SELECT doc_id, source FROM k WHERE key = ''")
def dedup_norm_key(t: Tables) -> DataFrame:
    return curate.first_by_key(keyed(t), "key", ["rank", "doc_id"]).select("doc_id", "source")


@query(KEYED + ", kept AS (SELECT doc_id, source FROM first WHERE rn = 1 UNION ALL SELECT doc_id, source FROM k WHERE key = '') SELECT source, count(*) AS n, count(kept.doc_id) AS kept, count(*) - count(kept.doc_id) AS dropped, round(coalesce(sum(CASE WHEN kept.doc_id IS NOT NULL THEN n_chars END), 0) / 3600.0, 6) AS hours FROM documents LEFT JOIN kept USING (doc_id, source) GROUP BY source")
def dup_counts(t: Tables) -> DataFrame:
    k = keyed(t)
    return curate.merge_report(curate.first_by_key(k, "key", ["rank", "doc_id"]), k, "source", "n_chars").withColumn("hours", F.round("hours", 6))


@query("""SELECT g AS source_group, lang, count(*) AS n FROM (SELECT lang, CASE WHEN starts_with(source, 'src1') THEN 'first' WHEN source IN ('src2', 'src3') THEN 'second' ELSE 'rest' END AS g FROM documents) GROUP BY g, lang""")
def source_split(t: Tables) -> DataFrame:
    group = curate.source_group(F.col("source"), {"src1": "first"}, {"second": ["src2", "src3"]}, "rest")
    return t.documents.select(group.alias("source_group"), "lang").groupBy("source_group", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(source || '_part_' || doc_id, '_[^_]*$', '') AS book FROM documents")
def book_from_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", curate.book_of(F.concat("source", F.lit("_part_"), F.col("doc_id").cast("string"))).alias("book"))


@query("""WITH g AS (SELECT unnest(['ñ', 'q', 'ğ', 'ç', 'ş', 'c', 'j', 'h']) AS grapheme), d AS (SELECT lower(text) AS low FROM documents)
SELECT grapheme, CAST(sum(length(low) - length(replace(low, grapheme, ''))) AS BIGINT) AS total, count(*) FILTER (contains(low, grapheme)) AS clips, round(count(*) FILTER (contains(low, grapheme)) / count(*)::DOUBLE, 9) AS rate,
  CASE WHEN count(*) FILTER (contains(low, grapheme)) / count(*)::DOUBLE >= 0.02::DOUBLE THEN 'OK' WHEN count(*) FILTER (contains(low, grapheme)) > 0 THEN 'LOW' ELSE 'MISSING' END AS status FROM g, d GROUP BY grapheme""")
def grapheme_coverage(t: Tables) -> DataFrame:
    return qc.grapheme_coverage(t.documents).withColumn("rate", F.round("rate", 9))


@query("SELECT unnest(['ğ']) AS grapheme WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'ğ')) UNION ALL SELECT 'ñ' WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'ñ')) UNION ALL SELECT 'q' WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'q'))")
def missing_graphemes(t: Tables) -> DataFrame:
    return qc.missing_critical(qc.grapheme_coverage(t.documents))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), k AS (SELECT *, greatest(1, n // 100) AS step FROM o)
SELECT doc_id, (i % step = 0) AND (i < step * 100) AS is_eval FROM k""")
def kth_split(t: Tables) -> DataFrame:
    return curate.kth_split(t.documents.select("doc_id"), "doc_id", 100).select("doc_id", "is_eval")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) AS n FROM documents) WHERE (n - 1) % 7 = 0")
def systematic_sample(t: Tables) -> DataFrame:
    return curate.systematic_sample(t.documents.select("doc_id", "lang"), ["lang", "doc_id"], 7).select("doc_id")


@query(CLIPS + """, r AS (SELECT id, book, dur, row_number() OVER (PARTITION BY book ORDER BY score DESC, id) AS turn FROM clips WHERE score >= -0.9::DOUBLE AND dur BETWEEN 4 AND 300),
b AS (SELECT *, coalesce(sum(dur) OVER (ORDER BY turn, book ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT id, book, turn FROM b WHERE before < 3600""")
def round_robin_budget(t: Tables) -> DataFrame:
    ok = qc.clips(t.documents).filter((F.col("score") >= -0.9) & F.col("dur").between(4, 300))
    return curate.round_robin(ok, "book", F.desc("score"), "dur", 3600.0, "id").select("id", "book", "turn")


@query(r"SELECT doc_id, trim(regexp_replace(replace(text, '|', '/'), '\s+', ' ', 'g')) AS field FROM documents")
def pipe_fields(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.pipe_field(F.col("text")).alias("field"))


@query("SELECT doc_id, substr(sha1(concat_ws('|', source, lang, CAST(doc_id AS VARCHAR))), 1, 12) AS key FROM documents")
def stable_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("key"))


@query("SELECT doc_id, length(replace(text, ' ', '')) AS nonspace, regexp_matches(text, '[а-яёА-ЯЁ]') AS cyrillic FROM documents")
def text_measures(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.nonspace(F.col("text")).alias("nonspace"), X.is_cyrillic(F.col("text")).alias("cyrillic"))


@query("""WITH s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS chars, n_chars / 14.0::DOUBLE * (1 + doc_id % 4) / 1.5::DOUBLE AS secs FROM documents)
SELECT doc_id, CASE WHEN secs < 20 OR chars < 200 THEN 'skip' WHEN chars / (secs * 14.0::DOUBLE) BETWEEN 0.45::DOUBLE AND 2.2::DOUBLE THEN 'whole' WHEN chars / (secs * 14.0::DOUBLE) > 2.2::DOUBLE THEN 'sliced' ELSE 'skip' END AS kind FROM s""")
def staging_kinds(t: Tables) -> DataFrame:
    chars = F.col("n_chars").cast("double")
    secs = chars / 14.0 * (1 + F.col("doc_id") % 4) / 1.5
    return t.documents.select("doc_id", match.staging(secs, chars)["kind"].alias("kind"))


@query(CLIPS + """, tiers AS (SELECT unnest(['strong', 'title-only', 'author-only', 'weak', 'none']) AS tier, unnest([0, 1, 2, 3, 4]) AS pos),
c AS (SELECT CASE WHEN score >= -0.3::DOUBLE THEN 'strong' WHEN score >= -0.6::DOUBLE THEN 'title-only' WHEN score >= -0.9::DOUBLE THEN 'weak' ELSE 'none' END AS tier, count(*) AS n FROM clips GROUP BY 1)
SELECT CAST(pos AS INT) AS pos, tier, coalesce(n, 0) AS n FROM tiers LEFT JOIN c USING (tier)""")
def tier_zero_fill(t: Tables) -> DataFrame:
    s = F.col("score")
    tier = F.when(s >= -0.3, "strong").when(s >= -0.6, "title-only").when(s >= -0.9, "weak").otherwise("none")
    return match.tier_counts(qc.clips(t.documents).withColumn("tier", tier), "tier", match.TIERS)


@query()
def sentences(t: Tables) -> DataFrame:
    """Sentences of every document after cleaning and un-wrapping."""
    return t.documents.select("doc_id", F.posexplode(X.split_sentences(X.clean(F.col("text")))).alias("pos", "sentence"))


def _spelled(sql: str) -> str:
    """SQL for the skeleton's replacements, in order."""
    for a, b in X.CYRILLIC_SKELETON + X.LATIN_SKELETON:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


@query(f"""WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_spelled("lower(nfc_normalize(text))")}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS skeleton FROM documents),
s AS (SELECT *, substr(regexp_replace(replace(skeleton, ' ', '_'), '^_+|_+$', '', 'g'), 1, 60) AS cut FROM k)
SELECT doc_id, skeleton, CASE WHEN cut = '' THEN 'item' ELSE cut END AS slug FROM s""")
def skeletons(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.skeleton(F.col("text")).alias("skeleton"), X.slug(F.col("text")).alias("slug"))


@query("""WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/?$', 1), '\\[[A-Za-z0-9_-]{11}\\]', '', 'g') AS s FROM pages),
p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(s, '^\\d{6,8}\\s*-\\s*', ''), '^\\d+_', ''), '([^./])\\.[^./]*$', '\\1') AS s FROM u)
SELECT page_id, trim(regexp_replace(regexp_replace(lower(s), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM p""")
def norm_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.norm_title(F.regexp_extract("url", r"([^/]*)/?$", 1)).alias("title"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word, generate_subscripts(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1) AS i FROM documents),
r AS (SELECT doc_id, i, regexp_replace(strip_accents(replace(lower(word), 'ß', 'ss')), '[^a-z'']', '', 'g') AS token FROM w),
s AS (SELECT doc_id, string_agg('<star> ' || trim(regexp_replace(token, '(.)', '\\1 ', 'g')), ' ' ORDER BY i) AS starred FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN trim(text) = '' THEN '' WHEN text IS NOT NULL THEN starred END AS starred FROM documents LEFT JOIN s USING (doc_id)""")
def romanized(t: Tables) -> DataFrame:
    """Every word in plain letters, spaced, after a star; its SQL knows Latin letters under marks and the sharp s."""
    words = X.words(F.col("text"))
    return t.documents.select("doc_id", F.array_join(X.alignment_inputs(words)["tokens_starred"], " ").alias("starred"))

"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, exactdedup, fingerprints, html, langid, oracles, packing, pii, quality, search, simjoin, tokens, toxicity, whitening
from skein.llm.common import table


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.report(table(spark, sf_dir, "documents"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11_whitening says that no component decides."""
    return op11_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_pii says of the base kinds."""
    return op2_pii(spark, sf_dir).drop("spans", "scores")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_fingerprints without the digests."""
    return op9_fingerprints(spark, sf_dir).drop("fingerprint", "edited_fingerprint")


def packing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its pieces, their bytes, and what is wrong with them (bytes missing or twice, bins that overflow or
    hold a source or text twice)."""
    return packing.audit(op8_packing(spark, sf_dir))


_MAIN = (op1_token_ids, op2_pii, op3_html, op4_toxicity, op5_decontaminate, op6_quality, op7_jaccard, op8_packing, op9_fingerprints, op10_language, op11_whitening, op12_search, op13_exact_dedup)
QUERIES = {f.__name__: f for f in (*_MAIN, whitening_deviations, pii_base_spans, fingerprint_edits, packing_faults)}
ORACLES: dict[str, str] = {
    "op3_html": oracles.HTML,
    "op5_decontaminate": oracles.LEAKS,
    "op7_jaccard": oracles.JACCARD,
    "op12_search": oracles.RANKED,
    "op13_exact_dedup": oracles.EXACT,
    "whitening_deviations": oracles.DEVIATIONS,
    "pii_base_spans": oracles.PII_BASE,
    "fingerprint_edits": oracles.EDITS,
    "packing_faults": oracles.PACKED,
}

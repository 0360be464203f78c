"""Small tables for the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    """One document for each text, doc_ids ascending; a text may be None."""
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}

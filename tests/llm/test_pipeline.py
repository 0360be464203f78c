import re

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.common import table
from tests.llm.test_decontaminate import expected as leaks
from tests.llm.test_simjoin import expected as components

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        kept[name] = (docs, out := spark.read.parquet(f"{tmp_path}/{len(kept)}"))
        docs = out
    for name in names[:-1]:
        assert kept[name][1].columns == kept[name][0].columns
    before, after = kept["quality classifier"]
    labels = table(spark, SF, "labels")
    good = before.join(labels.filter("quality = 1"), "doc_id")
    assert good.join(after, "doc_id", "left_anti").count() <= 0.01 * good.count()
    bad = before.join(labels.filter("quality = 0"), "doc_id")
    assert bad.join(after, "doc_id", "left_semi").count() <= 0.1 * bad.count()
    before, after = kept["n-gram Jaccard join"]
    group = components(sorted((r.doc_id, r.text) for r in before.collect()), 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in group.items() if d == c)
    before, after = kept["benchmark decontamination"]
    found = leaks([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {d for d, _ in found}
    before, after = kept["PII"]
    assert before.count() == after.count() and not after.filter(F.col("text").rlike(r"[a-z]@[a-z0-9-]+\.[a-z]")).count()
    assert all(r.n_chars == len(r.text) for r in after.collect())
    changed = before.join(after.select("doc_id", F.col("text").alias("new")), "doc_id").filter("text != new").collect()
    assert changed and all(re.search(r"\[(EMAIL|IP|CARD|PHONE|IBAN|SECRET)\]", r.new) for r in changed)
    before, after = kept["best-fit packing"]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

import math
import pickle
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import langid, quality
from skein.llm.common import table
from tests.llm.helpers import docs, rows

BIG = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    d = table(spark, BIG, "documents")
    got = langid.report(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == d.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_corner_cases(spark):
    train = table(spark, "/root/testdata/sf0.001", "documents")
    m = langid.fit(train)
    got = rows(langid.predict(docs(spark, [None, "", "123 456 !?", "½ ²", "the and of", "zzqx" * 5000]), m))
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and got[4]["lang_pred"] == "en" and got[5]["lang_pred"] != "und"
    none = rows(langid.report(docs(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))))
    assert none[0]["lang_pred"] == "und" and langid.report(docs(spark, [])).count() == 0


def test_quality_held_out(spark):
    d, y = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = [r for r in quality.report(d, y).join(y, "doc_id").collect() if r.held_out]
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_quality_corner_cases(spark):
    y = table(spark, "/root/testdata/sf0.001", "labels")
    got = rows(quality.report(docs(spark, [None, "", "x" * 100_000, " \n "]), y))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.report(docs(spark, []), y).count() == 0
    assert rows(quality.report(docs(spark, ["a"]), y.limit(0)))[0]["score"] == 1.0
    assert quality.keep_good(docs(spark, ["a"]), y.limit(0)).columns == docs(spark, []).columns


def plain_backoff(model, text):
    """Languages' scores, word by word from the definition."""
    total = dict.fromkeys(model.languages, 0.0)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in model.words.names:
            got = [model.words.row(w, len(total))]
        else:
            for n in range(langid.LONGEST, 0, -1):
                pieces = [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)] if n <= len(w) + 2 else []
                got = [model.grams.row(g, len(total)) for g in pieces if g in model.grams.names]
                if got:
                    break
        for k, lang in enumerate(model.languages):
            total[lang] += sum(float(x[k]) for x in got) / max(len(got), 1)
    return total


def test_language_equals_plain_backoff(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    m = langid.fit(d)
    got = rows(langid.predict(d, m))
    for r in d.limit(80).collect():
        want = plain_backoff(m, r.text or "")
        best = max(want, key=want.get)
        assert abs(want[got[r.doc_id]["lang_pred"]] - want[best]) < 1e-3 * max(1, abs(want[best]))
        assert abs(got[r.doc_id]["score"] - 1 / sum(math.exp(v - want[best]) for v in want.values())) < 1e-3


def test_model_counts():
    """Log frequencies of words and n-grams from plain counts."""
    rows = [("a", "xy", 3), ("a", "z", 1), ("b", "xy", 1)]
    m = langid.build(rows, [(*k, n) for k, n in langid.pieces(rows).items()])
    assert m.languages == ["a", "b"] and set(m.words.names) == {"xy", "z"}
    assert math.isclose(m.words.row("xy", 2)[0], math.log(3.5 / 5.5), rel_tol=1e-5) and math.isclose(m.words.row("z", 2)[1], math.log(0.5 / 2.5), rel_tol=1e-5)
    assert set(m.grams.names) == {g for w in ("^xy$", "^z$") for n in range(1, 6) for g in (w[i : i + n] for i in range(len(w) - n + 1))}
    # letters and signs: 3 * 4 + 3 of a, 4 of b, five of them different
    one = sum(1 for g in m.grams.names if len(g) == 1)
    assert one == 5 and math.isclose(m.grams.row("^", 2)[0], math.log(4.5 / (15 + 0.5 * (len(m.grams.names) + 1))), rel_tol=1e-5)


def test_rare_languages_are_learned(spark):
    """Whatever the others have, a language with one document can be predicted."""
    texts = [(3 * k, " ".join(f"wort{k}x{i}" for i in range(200)), "de", "s", 1) for k in range(60)]
    texts += [(1000, "qala balaq suvuq yolda", "crh", "s", 1)]
    d = spark.createDataFrame([t for t in texts if zlib.crc32(str(t[0]).encode()) % 3 != 1], docs(spark, []).schema)
    assert d.filter("lang = 'crh'").count() == 1
    m = langid.fit(d)
    assert m.languages == ["crh", "de"] and Counter(rows(langid.predict(docs(spark, ["balaq yolda", "wort1x1 wort2x2"]), m))[k]["lang_pred"] for k in (0, 1)) == {"crh": 1, "de": 1}


def test_every_word_of_the_sample_is_learned(spark):
    """However many words a language has, and however texts are composed."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**i % 26] for i in range(5))
    texts = [" ".join(word(1000 * d + k) for k in range(1000)) for d in range(90)]
    texts = [f"{t} Caf\u00e9 cafe\u0301" for t in texts]
    d = docs(spark, texts)
    learned = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 3 != 1]
    m = langid.fit(d)
    want = {w for t in learned for w in langid.words_of(t)}
    assert set(m.words.names) == want and "caf\u00e9" in want and "cafe" not in want


def test_many_languages_make_a_sparse_model():
    """What workers get grows with the words seen, not with languages times words."""
    def model(languages):
        rows = [(f"l{x:03}", f"{chr(97 + x % 26)}{chr(97 + x // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}", 1 + k) for x in range(languages) for k in range(300)]
        return langid.build(rows, [(*k, n) for k, n in langid.pieces(rows).items()])

    few, many = model(20), model(100)
    size = lambda m: len(pickle.dumps(m))
    assert len(many.words.language) == 100 * 300 and len(many.words.names) == 100 * 300
    assert size(many) < 5.5 * size(few)
    rows_ = langid._Rows(many)
    got = list(langid.predict_texts(rows_, [f"{chr(97 + x % 26)}{chr(97 + x // 26)}ab" for x in range(100)]))
    assert [g for g, _ in got] == many.languages


def test_cache_and_blocks_change_nothing(spark, monkeypatch):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [r.text for r in d.select("text").collect()]
    m = langid.fit(d.limit(40))
    want = list(langid.predict_texts(langid._Rows(m), texts))
    monkeypatch.setattr(langid, "CACHE", 3)
    monkeypatch.setattr(langid, "TOGETHER", 50)
    assert list(langid.predict_texts(langid._Rows(m), texts)) == want


def plain_statistics(text):
    t = text or ""
    w, lines = t.split(), [x for x in t.split("\n") if x]
    n, k, m = max(len(t), 1), max(len(w), 1), max(len(lines), 1)
    count = lambda keep: sum(c in keep for c in t)
    upper, digit, symbol, bang, stop = sum(c.isupper() for c in t), count("0123456789"), count("#$%&*|=_~^<>{}[]\\@+/"), count("!?"), count(".,;:")
    return [len(t), len(w), len(t) / k, len(set(w)) / k, k / m, len(set(lines)) / m, upper / n, digit / n, symbol / n, bang / n, stop / n, bang / k, symbol / k, stop / k]


def test_quality_equals_plain_rules(spark):
    """Statistics and rules evaluated in plain Python."""
    d, y = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    model = quality.fit(d, y)
    assert model.rules
    got = rows(quality.score(d.limit(300), model))
    for r in got.values():
        s = dict(zip(quality.NAMES, plain_statistics(r["text"]), strict=True))
        z = model.bias + sum(w for w, c in model.rules if all((s[x] > cut) == above for x, above, cut in c))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9, r["doc_id"]


def test_quality_columns_of_any_name(spark):
    y = table(spark, BIG, "labels")
    names = ["_n", "_words", "stat_n_chars", "stat_digit", "_quality", "quality", "Quality_", "length", "a.b"]
    d = docs(spark, ["Some words, of a text. " * 20, None]).selectExpr("*", *[f"concat('kept', doc_id) as `{c}`" for c in names])
    scored = quality.score(d, quality.fit(table(spark, BIG, "documents"), y))
    assert scored.columns == [*d.columns, "score"] and all(r.asDict()[c] == f"kept{r.doc_id}" for r in scored.collect() for c in names)
    assert quality.keep_good(d, y.limit(0)).columns == d.columns and quality.keep_good(d, y.limit(0)).count() == 2
    with pytest.raises(ValueError):
        quality.score(scored, quality.Rules(0.0, ()))

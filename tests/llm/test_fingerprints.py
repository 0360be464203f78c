import hashlib
import unicodedata

from skein.llm import fingerprints
from skein.llm.common import table
from tests.llm.helpers import docs, rows


def canon(t):
    f = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(f.split())


def check(d):
    got, ordered = {}, sorted(((r.doc_id, r.text or "") for r in d.collect()))
    got = rows(fingerprints.edited_fingerprints(d))
    by_print, least = {}, {}
    for i, t in ordered:
        least.setdefault(canon(t), i)
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        g = got[i]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert g["near_edited"] == float(canon(edited) == canon(t)) and g["near_next"] == float(canon(nxt) == canon(t)), i
        assert g["class_id"] == least[canon(t)]
        for p, c in ((g["fingerprint"], canon(t)), (g["edited_fingerprint"], canon(edited))):
            assert len(p) == 32 and by_print.setdefault(p, c) == c
    assert len({g["fingerprint"] for g in got.values()}) == len(least)


def test_hand_made(spark):
    check(docs(spark, ["Straße  ONE", "STRASSE one", "strasse ONE ", None, "", "   ", "été", "ÉTÉ", "ﬁn", "FIN", "abc", "abcd", "abcdefgh", "😀😀😀😀😀😀😀😀", "x" * 40_000]))


def test_one_row_and_none(spark):
    check(docs(spark, ["only one"]))
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0


def test_table(spark, sf):
    check(table(spark, sf, "documents"))


def test_clash_of_digests_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda c: (F.length(c).cast("long"), F.lit(0).cast("long")))
    got = rows(fingerprints.fingerprint(docs(spark, ["aa", "bb", "aa", "ccc", "BB "])))
    assert [got[i]["class_id"] for i in range(5)] == [0, 1, 0, 3, 1] and [got[i]["class_size"] for i in range(5)] == [2, 2, 2, 1, 2]


def test_null_and_repeated_keys(spark):
    d = docs(spark, ["a", "b", "b"]).unionAll(docs(spark, ["a"])).unionAll(spark.createDataFrame([(None, "zz", "en", "s", 2)], docs(spark, []).schema))
    assert fingerprints.edited_fingerprints(d).count() == 5

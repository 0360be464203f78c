import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import curate, joins, match, models, ops, qc, segments
from skein.plans.registry import QUERIES


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_gate_boundaries(spark):
    rows = [(1, -0.95, 6.0, 13.0, False), (2, -0.951, 10.0, 5.0, False), (3, 0.0, 5.99, 5.0, False), (4, 0.0, 19.0, 3.5, False), (5, 0.0, 19.01, 5.0, True), (6, 0.0, 10.0, 13.01, True), (7, 0.0, 10.0, 3.49, False), (8, 0.0, 10.0, 5.0, True)]
    got = {r.id: r.reason for r in qc.gate(make(spark, rows, "id int, score double, char_rate double, dur double, has_digit boolean")).collect()}
    assert {k: v.split("(")[0] for k, v in got.items()} == {1: "", 2: "low_score", 3: "char_rate", 4: "", 5: "char_rate", 6: "duration", 7: "duration", 8: "has_digit"}
    assert got[6] == "duration(13.0)"


def test_tags_and_suspicion(spark):
    schema = "id int, min_wscore double, score double, n_weak int, n_words int, char_rate double, dur double"
    rows = [(1, -11.0, -0.62, 3, 10, 15.0, 12.0), (2, -11.5, -0.63, 4, 10, 15.1, 12.1), (3, 0.0, 0.0, 1, 0, 7.4, 3.9)]
    got = {r.id: ([t.tag for t in r.tags], r.suspicion) for r in qc.audit(make(spark, rows, schema)).collect()}
    assert got[1] == (["bad-word"], 2 + 1.1) and got[2][0] == ["bad-word!!", "low-match", "many-weak", "crammed", "long"] and got[3][0] == ["sparse", "short"]
    assert abs(got[2][1] - (3 + 2 + 1 + 1 + 1 + 1.15)) < 1e-9


def test_upper_median(spark):
    df = make(spark, [("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 5.0)], "k string, v double")
    assert {r.k: r.median for r in qc.upper_median(df, "k", "v").collect()} == {"a": 3.0, "b": 5.0}


def test_clip_metrics(spark):
    rows = [("c", "ab", 0.0, 1.0, -50.0, -1.0, True), ("c", "c3", 1.0, 2.0, -100.0, -3.0, False), ("d", "x", 1.0, 1.0, -2.0, -9.0, False)]
    got = {r.clip: r for r in qc.clip_metrics(make(spark, rows, "clip string, text string, start double, end double, score double, wscore double, real boolean")).collect()}
    assert (got["c"].score, got["c"].min_wscore, got["c"].n_weak, got["c"].char_rate, got["c"].has_digit) == (-1.5, -1.0, 1, 2.0, True)
    assert (got["d"].score, got["d"].min_wscore, got["d"].char_rate) == (-2.0, 0.0, 0.0)


def test_no_lines_is_an_error(spark):
    with pytest.raises(Exception, match="no input lines"):
        qc.grapheme_coverage(make(spark, [], "text string")).collect()


def test_band_join_is_the_theta_join(spark):
    rng = random.Random(1)
    a = make(spark, [(i, rng.choice([None, rng.uniform(-20, 20), float(rng.randrange(-5, 5))])) for i in range(150)], "i int, x double")
    b = make(spark, [(i, rng.choice([None, rng.uniform(-20, 20), float(rng.randrange(-5, 5))])) for i in range(150)], "j int, y double")
    got = sorted((r.i, r.j) for r in joins.band_join(a, b, "x", "y", 1.0).collect())
    assert got == sorted((r.i, r.j) for r in a.join(b, F.abs(a.x - b.y) <= 1.0).collect()) and got


def test_classes_and_partners(spark):
    df = make(spark, [("a", "x", 0.25, 4.0), ("a", "y", 0.1, 1.0), ("b", "y", 0.26, 2.0), ("c", "y", 0.26, 2.1)], "l string, r string, bit_error double, delta double")
    assert sorted((r.l, r.r, r["class"]) for r in joins.classify_pairs(df).collect()) == [("a", "x", "duplicate"), ("a", "y", "duplicate"), ("b", "y", "same-length")]
    assert {r.l: r.r for r in joins.best_partner(df, "l", ["bit_error", "r"]).collect()} == {"a": "y", "b": "y", "c": "y"}
    rates = make(spark, [(128, 128), (129, 128), (None, 1)], "y int, t int").select(joins.canonical_copy(F.col("y"), F.col("t"), "youtube", "telegram").alias("c"))
    assert [r.c for r in rates.collect()] == ["telegram", "youtube", "telegram"]


def test_orphans(spark):
    meta, media = make(spark, [("a", 10.0), ("b", 50.0), ("c", 11.0)], "k string, d double"), make(spark, [("a", 12.0), ("z", 14.0)], "k string, m double")
    assert {r.k: r.near for r in joins.orphans(meta, media, "k", "d", "m", 4.0).collect()} == {"b": 0, "c": 2}


def test_diff_first_existing_contains(spark):
    a, b = make(spark, [("x", "1"), ("s", "t"), ("history", "[]")], "key string, value string"), make(spark, [("x", "3"), ("new", "4")], "key string, value string")
    got = {r.key: (r.delta, r.arrow) for r in joins.metric_diff(a, b).collect()}
    assert got == {"x": (2.0, "↑"), "s": (None, None), "new": (None, None)}
    c = make(spark, [(1, ["p", "q"]), (2, ["n"]), (3, [])], "i int, c array<string>")
    assert {r.i: r.path for r in joins.first_existing(c, "c", make(spark, [("q",), ("r",)], "path string"), "path").collect()} == {1: "q", 2: None, 3: None}
    rec, fol = make(spark, [("Nenkejan Hanim!",), ("",)], "work string"), make(spark, [("1_nenkejan_hanim_x",), ("0 nenkejan hanim",)], "folder string")
    assert [(r.work, r.folder) for r in joins.contains_join(rec, fol, "work", "folder").collect()] == [("Nenkejan Hanim!", "0 nenkejan hanim")]


def test_packer():
    n = 40
    start, end = [i * 1.0 for i in range(n)], [i * 1.0 + 0.9 for i in range(n)]
    got = segments.pack_words(start, end, [i % 7 == 6 for i in range(n)])
    assert got[0] == (0, 6) and got[-1][1] == n - 1 and all(a == b + 1 for (a, _), (_, b) in zip(got[1:], got))
    assert segments.pack_words([0.0], [1.0], [True]) == [(0, 0)] and segments.pack_words([], [], []) == []
    assert segments.pack_words([0.0, 20.0], [15.0, 21.0], [False, True]) == [(0, 1)]
    gaps = [0.0, 1.0, 20.0, 21.0, 22.0, 23.0, 24.0]
    assert segments.pack_words(gaps, [x + 0.9 for x in gaps], [False] * 7) == [(0, 0), (1, 1), (2, 6)]


def test_packer_properties():
    """Every clip is the best choice of its first word, by trying all stops."""
    rng = random.Random(3)
    for _ in range(300):
        t, start, end = 0.0, [], []
        for _ in range(rng.randrange(1, 40)):
            start.append(t)
            end.append(t + rng.choice([0.2, 0.7, 2.5, 13.0]))
            t = end[-1] + rng.choice([0.0, 0.1, 0.3, 6.0])
        ends = [rng.random() < 0.2 for _ in start]
        n, want, i = len(start), [], 0
        while i < n:
            table = {}
            for j in range(i, n):
                length = end[j] - start[i]
                if j > i and length > 12:
                    break
                if length >= 4 or j == n - 1:
                    table[j] = -0.15 * abs(length - 7) + 3 * ends[j] + (j == n - 1 or start[j + 1] - end[j] >= 0.12)
            top = min((j for j in table if table[j] == max(table.values())), default=i)
            want.append((i, top))
            i = top + 1
        if len(want) > 1 and end[-1] - start[want[-1][0]] < 4:
            want[-2:] = [(want[-2][0], n - 1)]
        assert segments.pack_words(start, end, ends) == want


def test_small_operators(spark):
    jobs = spark.createDataFrame([(1, "running", 1), (2, "running", 0), (3, "queued", 1)], "id long, status string, cancel int")
    assert [r.id for r in ops.cancel_set(jobs).collect()] == [1]
    clips = spark.createDataFrame([(0.90, 4.0), (0.90, 9.0), (0.89, 5.0), (0.95, 9.1)], "s double, d double")
    assert [r.c for r in clips.select(curate.eligible(F.col("s"), F.col("d")).alias("c")).collect()] == [True, True, False, False]
    rows = spark.createDataFrame([("x", 2, "b", 5), ("x", 1, "c", 6), ("", 1, "d", 7), (None, 1, "e", 8), ("y", 3, "f", 9)], "k string, rank int, _rn string, h1 int")
    assert sorted(r._rn for r in curate.first_by_key(rows, "k", ["rank"]).collect()) == ["c", "d", "e", "f"]
    got = curate.ranked(rows.withColumnsRenamed({"_rn": "_part", "h1": "_cost"}), ["_part"]).collect()
    assert [r.rn for r in sorted(got, key=lambda r: r._part)] == [1, 2, 3, 4, 5] and got[0]._cost is not None


def test_intervals(spark):
    df = make(spark, [("f", 0.0, 1.0), ("f", 1.3, 2.0), ("f", 2.5, 3.0), ("g", 0.0, 25.0), ("g", 30.0, 33.0)], "k string, s double, e double")
    assert sorted((r.k, r.s, r.e) for r in segments.merge_close(df, "k", "s", "e", 0.4).collect()) == [("f", 0.0, 2.0), ("f", 2.5, 3.0), ("g", 0.0, 25.0), ("g", 30.0, 33.0)]
    nested = make(spark, [("f", 0.0, 9.0), ("f", 1.0, 2.0), ("f", 9.2, 10.0), ("f", 11.0, 12.0)], "k string, s double, e double")
    assert sorted((r.s, r.e, r.parts) for r in segments.merge_close(nested, "k", "s", "e", 0.4).collect()) == [(0.0, 10.0, 3), (11.0, 12.0, 1)]
    got = sorted((r.k, r.chunk_start, r.chunk_end) for r in segments.chunk_intervals(df, "s", "e", 3.5, 10.0).collect())
    assert got == [("g", 0.0, 10.0), ("g", 10.0, 20.0), ("g", 20.0, 25.0)]


def test_text_bounds(spark):
    text = "a" * 300 + "\n\n" + "b" * 300
    got = {r.p: (r.lo, r.hi) for r in segments.text_bounds(make(spark, [("w", 0, 1.0, text), ("w", 1, 1.1, text)], "k string, p int, s double, t string"), "k", "p", "s", "t").collect()}
    assert got == {0: (0, 286), 1: (286, 602)} or got == {0: (0, 300), 1: (300, 602)}


def test_windows_of_a_long_alignment():
    got = list(segments.align_windows(1000, 2000.0, [i * 2.0 for i in range(1000)]))
    assert got[0] == (0, 375, 0.0, 600.0) and got[1][0] == 375 and got[1][2] == 740.0 and got[-1][0] + got[-1][1] == 1000


def test_first_by_key_and_rank(spark):
    df = make(spark, [("k", 2, "b"), ("k", 1, "a"), ("", 1, "x"), ("", 2, "y"), (None, 3, "z")], "key string, pos int, v string")
    assert sorted(r.v for r in curate.first_by_key(df, "key", ["pos"]).collect()) == ["a", "x", "y", "z"]
    ranked = curate.ranked(make(spark, [(i * 37 % 101,) for i in range(101)], "x int"), ["x"]).collect()
    assert all(r.rn == r.x + 1 for r in ranked)


def test_round_robin(spark):
    df = make(spark, [("a", 1, 0.9, 5.0), ("a", 2, 0.95, 5.0), ("b", 3, 0.99, 5.0), ("c", 4, 0.91, 5.0)], "g string, id int, sim double, dur double")
    assert sorted(r.id for r in curate.round_robin(df, "g", F.desc("sim"), "dur", 12.0, "id").collect()) == [2, 3, 4]


def test_splits_limits_checkpoints(spark):
    df = make(spark, [(i,) for i in range(10)], "id int")
    assert [r.id for r in curate.kth_split(df, "id", 3).filter("is_eval").orderBy("id").collect()] == [0, 3, 6]
    assert curate.only(df, "id", []).count() == 10 and curate.only(df, "id", [1, 2]).count() == 2
    assert curate.token_limit(make(spark, [([1, 2],), ([1, 2, 3],)], "t array<int>"), "t", 3).count() == 1
    c = make(spark, [("r", "e1", 1, 2), ("r", "e2", 2, 2), ("r", "e3", 3, 2), ("q", "f1", 1, 9), ("q", "f5", 5, 9)], "run string, path string, epoch int, best_epoch int")
    assert {r.run: r.path for r in curate.best_checkpoint(c, "run").collect()} == {"r": "e2", "q": "f5"}
    names = make(spark, [("ck_9",), ("ck_10",), ("final_1",)], "n string").orderBy(curate.numeric_suffix(F.col("n"))).collect()
    assert [r.n for r in names] == ["ck_9", "ck_10", "final_1"]


def test_routes(spark):
    rules = [("grandpa", "qartbaba", "grandpa"), ("girl", "qiz", "girl")]
    recipes = {"grandpa": F.struct(F.lit(-4).alias("pitch")), "girl": F.struct(F.lit(17).alias("pitch")), "narrator": F.struct(F.lit(-1).alias("pitch"))}
    got = curate.route(make(spark, [("my_qiz_dir",), ("grandpa",), ("other",)], "d string"), F.col("d"), rules, recipes, "narrator").collect()
    assert [(r.role, r.recipe.pitch) for r in got] == [("girl", 17), ("grandpa", -4), ("narrator", -1)]


def test_titles_and_tiers(spark):
    got = make(spark, [("Ali Veli. Kitap adı",), ("one two three four five. x",), ("no dot",), ("end.",)], "t string").select(match.parse_title(F.col("t")).alias("p")).collect()
    assert [(r.p.author, r.p.work) for r in got] == [("Ali Veli", "Kitap adı"), ("", "one two three four five. x"), ("", "no dot"), ("", "end.")]
    rows = make(spark, [(None, None, 0), (0.6, 0.85, 2), (0.6, 0.84, 2), (0.6, 0.85, 1), (0.5, 0.5, 2)], "t double, a double, n int")
    assert [r.x for r in rows.select(match.tier(F.col("t"), F.col("a"), F.col("n")).alias("x")).collect()] == ["none", "strong", "title-only", "author-only", "weak"]
    swap = match.repair_swap(make(spark, [("Real work", "Qırım halq masalı"), ("Real work", "halq masalları"), ("A", "B")], "author string, work string")).collect()
    assert [(r.author, r.work) for r in swap] == [("", "Real work"), ("", "Real work"), ("A", "B")]


def test_candidates_with_and_without_blocks(spark):
    rec = make(spark, [(1, "Abdulla", "Kitap adini yazdim"), (2, "", "zz")], "id long, author string, work string")
    books = make(spark, [("b1", ["kitap", "adini", "yazdim", "abdulla"]), ("b2", ["nothing", "here"])], "path string, tokens array<string>")
    a = match.candidates(rec, books).collect()
    assert [(r.id, r.path, r.tier) for r in a] == [(1, "b1", "strong")] == [(r.id, r.path, r.tier) for r in match.candidates(rec, books, blocked=True).collect()]


def test_blocks_lose_no_candidate(spark):
    """Hits inside a token, and fuzzy ones that differ at the start, share no first letters."""
    rec = make(spark, [(1, "", "iereau turbesi"), (2, "", "kitaplar hanimlar"), (3, "bdullayev", "zz"), (4, "Abdullayeva", "yazdimlar"), (4, "Abdullayeva", "yazdimlar")], "id long, author string, work string")
    books = make(spark, [("b1", ["xxiereauxx"]), ("b2", ["itaplar", "something"]), ("b2", ["itaplar", "something"]), ("b3", ["abdullayev"]), ("b4", ["yazd", "abdullay"]), ("b5", [])], "path string, tokens array<string>")
    got = [sorted(tuple(r) for r in match.candidates(rec, books, blocked=x, top=9).select("id", "path", "score", "tier").collect()) for x in (False, True)]
    assert got[0] == got[1] and {(1, "b1"), (2, "b2"), (3, "b3")} <= {r[:2] for r in got[1]} and len(got[1]) > 5


def test_blocks_equal_every_pair(spark):
    """Repeated tokens, several works of one recording, several books of one path, authors that decide between equal titles."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(4, 9)))
    known = [word() for _ in range(40)]
    some = lambda n: [str(x) for x in rng.choice(known, n)]
    rec = make(spark, [(int(rng.integers(25)), " ".join(some(rng.integers(0, 3))), " ".join([*some(rng.integers(0, 4)), word()])) for _ in range(40)], "id long, author string, work string")
    books = make(spark, [(f"b{rng.integers(9)}", some(rng.integers(0, 12))) for _ in range(14)], "path string, tokens array<string>")
    for top in (1, 3):
        got = [sorted(tuple(r) for r in match.candidates(rec, books, top=top, blocked=x).select("id", "rn", "path", "title_score", "author_score", "score", "tier").collect()) for x in (False, True)]
        assert got[0] == got[1] and len(got[0]) > 10


def test_few_pairs_of_tokens_are_compared(spark):
    """Tokens of like length without like letters are not compared letter by letter."""
    q = make(spark, [("".join(x),) for x in itertools.combinations("abcdefghijklmnop", 4)], "_q string")
    p = q.select(F.col("_q").alias("_p"))
    assert match.near_pairs(q, p).count() == match.token_hits(q, p).count() == q.count()
    odd = make(spark, [("",), ("kitaplar",)], "_q string")
    assert {(r["_q"], r["_p"]) for r in match.token_hits(odd, odd.select(F.col("_q").alias("_p"))).collect()} == {("", ""), ("kitaplar", ""), ("kitaplar", "kitaplar")}


def test_verify(spark):
    m = make(spark, [(1, "nenkejan hanim turbesi", "a"), (2, "bir", "a"), (3, "nenkejan hanim turbesi", "none"), (4, "totally other title", "a")], "id long, work string, book string")
    books = make(spark, [("a", "eski nenkejan hanim turbesi eken")], "book string, text string")
    assert {r.id: r.verdict for r in match.verify(m, books).collect()} == {1: "confirmed", 2: "inconclusive", 3: "unreadable", 4: "absent"}


def test_staging_and_pages(spark):
    rows = make(spark, [(19.9, 9000), (100.0, 199), (100.0, 1400), (100.0, 5000), (100.0, 300)], "s double, c int").select(match.staging(F.col("s"), F.col("c"))["kind"].alias("k"))
    assert [r.k for r in rows.collect()] == ["skip", "skip", "whole", "sliced", "skip"]
    pages = [f"p{i}" for i in range(40)]
    got = make(spark, [(pages, None), (pages[:15], None), (["x"], "longer cached text")], "p array<string>, c string").select(match.page_window(F.col("p"), F.col("c")).alias("t")).collect()
    assert got[0].t.split("\n") == pages[:12] + pages[30:] and got[1].t.split("\n") == pages[:15] and got[2].t == "longer cached text"


def test_job_states(spark):
    ev = [(1, 1, "claim"), (1, 2, "done"), (1, 3, "failed"), (2, 1, "cancel"), (3, 1, "claim"), (3, 2, "cancel"), (3, 3, "done"), (4, 1, "no_signal"), (5, 1, "claim"), (6, 1, "done")]
    assert {r.id: r.status for r in ops.job_states(make(spark, ev, "id int, ts int, event string")).collect()} == {1: "done", 2: "canceled", 3: "canceled", 5: "running", 6: "queued"}


def test_upsert_insert_validate(spark):
    t, n = make(spark, [(1, "a", 1), (2, "b", 1)], "k int, v string, ts int"), make(spark, [(2, "c", 1), (3, "d", 0)], "k int, v string, ts int")
    assert {r.k: r.v for r in ops.upsert(t, n, ["k"], "ts").collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.k: r.v for r in ops.insert_ignore(t, n, ["k"]).collect()} == {1: "a", 2: "b", 3: "d"}
    with pytest.raises(Exception, match="bad v"):
        ops.validate(t, "v", ["a"]).collect()


def test_upcoming_keeps_unreadable(spark):
    df = make(spark, [("2024-01-01T00:00:00",), ("2024-03-01T00:00:00+02:00",), ("bad",), (None,)], "end_iso string")
    assert sorted(str(r.end_iso) for r in ops.upcoming(df, F.lit("2024-02-01").cast("timestamp")).collect()) == ["2024-03-01T00:00:00+02:00", "None", "bad"]


def test_logs(spark):
    lines = make(spark, [("Epoch [46/80], Step [520/670], Loss: 0.33, Disc Loss: 2, F0 Loss: 1.75",), ("noise",)], "line string")
    r = ops.parse_log(lines).collect()
    assert len(r) == 1 and (r[0].epoch, r[0].epochs, r[0].step, r[0].steps) == (46, 80, 520, 670) and r[0].losses["F0"] == 1.75 and r[0].losses["Disc"] == 2.0


def test_queue(spark):
    j = make(spark, [(1, "gpu", "queued", 1, None, "t"), (2, "gpu", "queued", 5, 200.0, "t"), (3, "cpu", "queued", 0, 50.0, "t"), (4, "gpu", "done", 9, None, "t")], "id long, device string, status string, priority int, run_at double, type string")
    assert [r.id for r in ops.queue_head(j, "gpu", 100.0).collect()] == [1] and [r.id for r in ops.queue_head(j, "gpu", 300.0).collect()] == [2]
    assert {r.device: r.id for r in ops.assign(j, 100.0).collect()} == {"gpu": 1, "cpu": 3}


def test_centroids_and_scaling(spark):
    df = make(spark, [("a", [1.0, 0.0]), ("a", [0.9, 0.1]), ("a", [0.0, 1.0]), ("b", [0.0, 2.0])], "g string, v array<double>")
    got = {r.g: (r.kept, r.total, r.centroid) for r in models.trimmed_centroid(df, "g", "v", 0.8).collect()}
    assert got["a"][:2] == (2, 3) and got["b"] == (1, 1, [0.0, 1.0])
    z = models.zscore(make(spark, [(1.0,), (3.0,)], "x double"), make(spark, [(2.0,), (4.0,)], "x double"), ["x"]).orderBy("x").collect()
    assert z[0].x == 0.0 and abs(z[1].x - 2 / (1 + 1e-6)) < 1e-9


def test_plans_take_whole_texts(spark, tmp_path):
    """All lines of a text are romanised and made skeletons of; an item is looked for in every document."""
    tables = {"documents": [(7, "unrelated words here\nnothing said"), (8, "some heading\nthe quick brown foxes jumped over lazy sleeping dogs yesterday evening")],
              "benchmark": [(7, "quick brown foxes jumped over lazy sleeping dogs yesterday evening")]}
    for name, rows in tables.items():
        make(spark, rows, f"{'doc_id' if name == 'documents' else 'item_id'} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert "d o g s" in {r.doc_id: r.starred for r in run("romanized")}[8]
    assert {r.doc_id: r.skeleton for r in run("skeletons")}[7] == "unrelated vords here nothing said"
    assert [(r.id, r.book, r.verdict) for r in run("verified_matches")] == [(7, "8", "confirmed")]

"""Operators on small fixtures with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import parsing as ps
from lodestream.functions import text as tx
from lodestream.functions import timefns as tm
from lodestream.functions import vectors as vec
from lodestream.functions.decisions import best_option, decision_list, reasons, true_labels
from lodestream.operators import diversity, evaluate, intervals, relational, selection


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("token", "strict", "loose"),
    [("11094208", 40182080, 40182080), ("110942", None, 40182000), ("1109420", None, 40182000), ("11:09:42.08", None, 40182080), ("11604208", None, None), ("", None, None), (None, None, None), ("123", None, None)],
)
def test_time_tokens(spark, token, strict, loose):
    t = F.lit(token).cast("string")
    assert (value(spark, tm.token_millis(t)), value(spark, tm.loose_token_millis(t))) == (strict, loose)


def test_clocks(spark):
    assert value(spark, tm.clock_millis(F.lit("9:05:07.5"))) == 32707500
    assert value(spark, tm.clock_millis(F.lit("9:65:07"))) is None
    assert value(spark, tm.millis_clock(F.lit(40182080))) == "11:09:42.080"
    assert value(spark, tm.millis_clock(F.lit(86_400_000 + 1))) == "00:00:00.001"
    assert [value(spark, tm.day_period(F.lit(h * 3_600_000))) for h in (5, 6, 12, 17, 23)] == ["night", "morning", "afternoon", "evening", "evening"]
    assert value(spark, tm.wrap_midnight(F.lit(100), F.lit(50))) == 86_400_050


def test_text_functions(spark):
    assert value(spark, tx.space_tokens(F.lit("Çé,  x!"))) == ["çé", "", "x"]
    assert value(spark, tx.shorten(F.lit("abcdefgh ijk"), 10)) == "abcdefg..."
    assert value(spark, tx.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert [value(spark, tx.stem(F.lit(w), {"missed": "miss"})) for w in ("walking", "missed", "boxes", "tables", "does")] == ["walk", "miss", "boxes"[:-2] if len("boxes") > 5 else "boxes", "tabl", "does"]
    assert value(spark, tx.has_any(F.lit("Back-up of the day"), ["back-up"])) and not value(spark, tx.has_any(F.lit("because"), ["cause"]))
    assert value(spark, tx.choice_strict(F.lit("because"))) == 1 and value(spark, tx.choice_loose(F.lit("zzz"))) is None
    assert value(spark, tx.choice_loose(F.lit("I say (C)"))) == 2
    assert value(spark, tx.snippet(F.lit("abc needle xyz"), "needle", 2)) == "c needle x"
    assert value(spark, tx.snippet(F.lit("abc"), "needle", 2)) is None


def test_parsing(spark):
    good = value(spark, ps.clip_path(F.lit("A1_ANN/DAY1/DAY1_A1_ANN_11094208.mp4")))
    assert good.asDict() == {"day": 1, "agent_id": 1, "agent": "Ann", "token": "11094208"}
    assert value(spark, ps.clip_path(F.lit("A1_ANN/DAY2/DAY1_A1_ANN_11094208.mp4"))) is None
    windows = value(spark, ps.context_windows(F.lit("x DAY1 11:09:42 - 11:10:15, Ann: a DAY2 1:00:00 - 1:00:05")))
    assert [w.asDict() for w in windows] == [{"day": 1, "start": "11:09:42", "end": "11:10:15"}, {"day": 2, "start": "1:00:00", "end": "1:00:05"}]
    assert value(spark, ps.json_block(F.lit('text ```json\n{"a": 1}\n``` more'))) == '{"a": 1}'
    assert value(spark, ps.json_block(F.lit("none"))) is None
    assert value(spark, ps.stable_id(F.lit("a/b"), F.lit(""), F.lit(None).cast("string"), F.lit("c d"))) == "a-b_c_d"
    assert [value(spark, ps.truncated_int_or(F.lit(x), -1)) for x in ("12.9", "-12.9", "x")] == [12, -12, -1]


def test_decisions(spark):
    row = {"a": F.lit(2), "b": F.lit(2), "c": F.lit(None).cast("int")}
    assert value(spark, best_option(row)) == "a"
    assert value(spark, decision_list([(F.lit(False), "x"), (F.lit(True), "y")], "z")) == "y"
    assert value(spark, true_labels({"x": F.lit(True), "y": F.lit(False), "z": F.lit(True)})) == ["x", "z"]
    assert value(spark, reasons([(F.lit(True), "one"), (F.lit(False), "two"), (F.lit(True), "three")])) == "one | three"


def test_projection(spark):
    point = vec.gaze_point(F.lit(0.0), F.lit(0.0), F.lit(2.0))
    identity = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    px, py = vec.pinhole(vec.affine(identity, point), 100, 100, 320, 240)
    assert (value(spark, px), value(spark, py)) == (320, 240)
    px, _ = vec.pinhole([F.lit(0.0), F.lit(0.0), F.lit(-1.0)], 1, 1, 0, 0)
    assert value(spark, px) is None
    assert value(spark, vec.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


@pytest.mark.parametrize("bin_ms", [1, 7, 100])
def test_interval_join_is_complete_and_without_duplicates(spark, bin_ms):
    rng = random.Random(bin_ms)
    make = lambda n: [(i, rng.randrange(2), a := rng.randrange(-40, 40), a + rng.randrange(0, 30)) for i in range(n)]
    left, right = make(40), make(40)
    l_df = spark.createDataFrame(left, "l long, k int, start_ms long, end_ms long")
    r_df = spark.createDataFrame(right, "r long, k int, start_ms long, end_ms long")
    for condition, test in (
        (intervals.strict_overlap(), lambda a, b: a[2] < b[3] and a[3] > b[2]),
        (intervals.touching(), lambda a, b: a[2] <= b[3] and a[3] >= b[2]),
        (intervals.left_inside_right(), lambda a, b: b[2] <= a[2] and b[3] >= a[3]),
    ):
        got = sorted((x["l"], x["r"]) for x in intervals.interval_join(l_df, r_df, ["k"], bin_ms, condition).collect())
        assert got == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and test(a, b))


def test_interval_join_has_no_nested_loop(spark):
    df = spark.range(10).select(F.col("id").alias("l"), F.lit(1).alias("k"), F.col("id").alias("start_ms"), (F.col("id") + 3).alias("end_ms"))
    joined = intervals.interval_join(df, df.withColumnRenamed("l", "r"), ["k"], 5, intervals.touching())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_chunk_that_ends_before_the_window_is_in_both_pools(spark):
    chunks = spark.createDataFrame([(1, 1, 0, 30_000)], "event_id long, user_id long, start_ms long, end_ms long")
    windows = spark.createDataFrame([(7, 1, 90_000 - 120_000, 90_000 + 120_000, 90_000)], "window_id long, user_id long, start_ms long, end_ms long, core_ms long")
    near = intervals.interval_join(windows.drop("core_ms"), chunks, ["user_id"], 60_000, intervals.touching())
    assert near.count() == 1
    assert intervals.history_counts(chunks, windows, ["user_id"], "end_ms", "core_ms", "window_id").first()["n_history"] == 1


def test_dense_grid(spark):
    df = spark.createDataFrame([(1, 0, 2500), (2, 0, 400)], "id long, s long, e long")
    got = {(r["id"], r["at_ms"]) for r in intervals.dense_grid(df, "s", "e", 1000).collect()}
    assert got == {(1, 500), (1, 1500), (2, 200)}


def test_mmr_suppresses_then_fills_up(spark):
    rows = [(1, 1, 0.9, "v", 10, [1.0, 0.0]), (1, 2, 0.8, "v", 12, [1.0, 0.0]), (1, 3, 0.7, "v", 14, [0.9, 0.1]), (1, 4, 0.1, "w", 10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "q int, id int, score double, video string, at int, v array<double>")
    pick = lambda k: [r["id"] for r in diversity.mmr_select(df, "q", "id", "score", "video", "at", "v", k, gap=5).orderBy("pick").collect()]
    assert pick(2) == [1, 4]  # 2 and 3 lie within the gap of 1
    assert pick(3) == [1, 4, 2]  # the fill-up admits what was suppressed
    assert pick(9) == [1, 4, 2, 3]


def test_spaced_and_category_selection(spark):
    rows = [(1, i, at, day, p) for i, (at, day, p) in enumerate([(0, 1, "m"), (10, 1, "m"), (20, 1, "a"), (100, 2, "a"), (105, 2, "e"), (200, 3, "e")])]
    df = spark.createDataFrame(rows, "g int, id int, at int, day int, period string")
    got = [r["id"] for r in diversity.spaced_select(df, "g", "id", "at", "day", "period", 5, 15).orderBy("pick").collect()]
    assert got == [0, 3, 5, 2]  # one per period on new days, then those 15 apart
    docs = spark.createDataFrame([(1, 9, "a", "x"), (2, 8, "a", "y"), (3, 7, "b", "x"), (4, 6, "b", "z"), (5, 5, "a", "x")], "id int, s int, c string, p string")
    got = [r["id"] for r in diversity.category_pattern_select(docs, "id", "s", "c", "p", 5).orderBy("pick").collect()]
    assert got == [1, 4, 2, 3, 5]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_even_sample(spark, n):
    for m in (1, 2, 5, 6, 8):
        df = spark.range(m).withColumn("g", F.lit(1))
        got = sorted(r["id"] for r in selection.even_sample(df, ["g"], ["id"], n).collect())
        want = sorted({round(i * (m - 1) / (n - 1)) for i in range(n)}) if 1 < n < m else list(range(m)) if n >= m else [m // 2]
        assert got == want


def test_oracle_best_and_dense_cube(spark):
    df = spark.createDataFrame([(1, "a", "x", False, True), (1, "a", "x", True, True), (1, "b", "y", False, False), (2, "b", "y", False, True)], "q int, k string, m string, correct boolean, answered boolean")
    best = evaluate.best_of(df, "q", [], "correct", "answered").first()
    assert (best["questions"], best["correct"], best["accuracy"]) == (2, 1, 0.5)
    cube = {(r["k"], r["m"]): (r["trials"], r["accuracy"]) for r in evaluate.dense_cube(df, "k", "m", "correct").collect()}
    assert cube == {("a", "x"): (2, 0.5), ("a", "y"): (0, 0.0), ("b", "x"): (0, 0.0), ("b", "y"): (2, 0.0)}


def test_last_wins_and_merge(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, None)], "key string, file int, v string")
    assert {(r["key"], r["v"]) for r in relational.last_wins(df, ["key"], ["file"]).collect()} == {("k", "new"), ("j", None)}
    left = spark.createDataFrame([(1, "a"), (2, "")], "id int, v string")
    right = spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string")
    assert {(r["id"], r["v"]) for r in relational.merge_prefer_left(left, right, "id", ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    with pytest.raises(ValueError):
        relational.tagged_union({}, "t")


def test_fuzzy_and_json(spark):
    from lodestream.operators.variants import flatten_json
    from lodestream.plans.retrieval import fuzzy_ratio

    df = spark.createDataFrame([("kitchen table", "the kitchin and the tables"), (None, "x"), ("zzz", None)], "a string, b string")
    assert [r["fuzzy_score"] for r in fuzzy_ratio(df, "a", "b").collect()] == [4, 0, 0]
    doc = '{"speaker": "ann", "items": [{"timestamp": 3, "text": "hi"}, "a bare long string", {"speaker": "bob", "deep": {"caption": "yes"}}]}'
    got = flatten_json(spark.createDataFrame([(1, doc), (2, "{broken"), (3, None)], "id int, j string"), "id", "j").collect()
    assert [(r["speaker"], r["stamp"], r["text"]) for r in got] == [("ann", "3", "hi"), ("ann", None, "a bare long string"), ("bob", None, "yes")]
    assert list(itertools.chain.from_iterable([[r["n"]] for r in got])) == [0, 1, 2]


def test_mmr_query_reaches_a_diverse_frame_beyond_rank_twenty(spark, tmp_path):
    from math import cos, radians, sin

    from lodestream.plans.catalog import QUERIES

    turned = lambda degrees: [cos(radians(degrees)), sin(radians(degrees))]
    rows = [(0, 0, turned(0))] + [(10 * i + 1, 0, turned(20)) for i in range(30)] + [(901, 0, turned(-30))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["pick"]): r["vec_id"] for r in QUERIES["mmr_select"](spark, str(tmp_path)).collect()}
    assert (got[0, 1], got[0, 2]) == (1, 901)


def test_spaced_select_scans_a_hot_group_whole(spark):
    rows = [("u", i, i, 1, "am") for i in range(1500)] + [("u", 5000, 90_000, 2, "pm"), ("u", 5001, 95_000, 2, "pm"), ("v", 1, 5, 1, "am")]
    df = spark.createDataFrame(rows, "g string, id long, at long, day int, period string")
    got = diversity.spaced_select(df, "g", "id", "at", "day", "period", 5, 700)
    assert sorted((r["g"], r["pick"], r["id"]) for r in got.collect()) == [("u", 1, 0), ("u", 2, 5000), ("u", 3, 700), ("u", 4, 1400), ("u", 5, 5001), ("v", 1, 1)]


def test_category_pattern_select_looks_beyond_the_longest(spark):
    rows = [(i, 10_000 - i, "web", "en") for i in range(1500)] + [(9000, 5, "book", "fr"), (9001, 4, "web", "de")]
    df = spark.createDataFrame(rows, "id long, s long, c string, p string")
    got = diversity.category_pattern_select(df, "id", "s", "c", "p", 4).orderBy("pick").collect()
    assert [r["id"] for r in got] == [0, 9000, 9001, 1]


def test_items_meet_documents_of_every_residue(spark, tmp_path):
    """An item's evidence comes from all documents, whatever their ids."""
    from lodestream.plans.catalog import QUERIES

    text = "glacier telescope harbour"
    spark.createDataFrame([(1, text), (2, "violin")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(21, "violin", "src1"), (6, text, "src0"), (3, "harbour", "src1"), (4, None, "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r["item_id"], r["doc_id"]): r["shared"] for r in run("token_overlap")} == {(1, 6): 3, (1, 3): 1, (2, 21): 1}
    assert [(r["item_id"], r["doc_id"]) for r in run("bm25_okapi") if r["rank"] == 1] == [(1, 6), (2, 21)]


def labelled(spark, question, answer, texts, broad="^$", every="^$"):
    from lodestream.operators import evidence as ev

    asked = spark.createDataFrame([(1, question, answer)], "ask int, q string, a string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ranked = docs.select(F.lit(1).alias("ask"), "doc_id", (F.col("doc_id") + 1).alias("rank"))
    sets = ev.evidence_sets(ranked, docs, "ask", "doc_id", "text", ("the", "did"))
    return ev.assess(asked, sets, "ask", F.col("q"), F.col("a"), ("the", "did"), broad, every).first()


def test_evidence_labels(spark):
    question = "Where did the red lamp stand? A) kitchen table B) window sill, C) floor"
    r = labelled(spark, question, "B", ["a red lamp on the window sill"])
    assert (r["label"], r["hits"], r["coverage"], r["direct"]) == ("likely", ["sill", "window"], 1.0, False)
    r = labelled(spark, question, "window  sill", ["a red lamp", "by the Window Sill"])
    assert (r["label"], r["direct"], r["n_ranked"]) == ("likely", True, 2)
    assert labelled(spark, question, "A-B", ["a red lamp on the kitchen table"])["label"] == "partial"
    assert labelled(spark, question, "C", ["a red lamp"])["label"] == "not"
    assert labelled(spark, question, "C", ["one red lamp where kitchen"])["label"] == "unclear"
    assert labelled(spark, question, "C", [])["reason"] == "no evidence"
    wide = "red lamp stand kitchen table window sill floor where"
    assert labelled(spark, question, "C", [wide] * 6, broad="lamp")["label"] == "likely"
    assert labelled(spark, question, "C", [wide] * 6, broad="lamp", every="red")["label"] == "partial"
    assert labelled(spark, question, "C", [wide] * 3, broad="lamp")["label"] == "partial"
    assert value(spark, tx.expand_options(F.lit(question), F.lit("A-C"))) == "kitchen table floor"
    assert value(spark, tx.expand_options(F.lit(question), F.lit(" free  text "))) == "free text"
    assert value(spark, tx.expand_options(F.lit("no options"), F.lit("D"))) == "D"


def test_gain_needs_relevant_history(spark):
    from lodestream.operators import evidence as ev

    scope = lambda label, coverage=0.0, overlap=0, hits=(): F.struct(F.lit(label).alias("label"), F.lit(coverage).alias("coverage"), F.lit(overlap).alias("overlap"), F.array(*map(F.lit, hits)).cast("array<string>").alias("hits"))
    gain = lambda *s: value(spark, ev.gain_label(*s))
    assert gain(scope("not"), scope("partial"), scope("likely")) == "yes"
    assert gain(scope("not"), scope("not"), scope("likely")) == "unclear"
    assert gain(scope("not"), scope("unclear", 0.25), scope("unclear")) == "promising"
    assert gain(scope("likely"), scope("partial"), scope("likely", hits="x")) == "no"
    assert gain(scope("partial", hits="a"), scope("partial"), scope("partial", hits="ab")) == "promising"
    assert gain(scope("partial", hits="a"), scope("partial"), scope("partial", hits="a")) == "no"
    assert value(spark, ev.best_scope(scope("partial"), scope("partial"), scope("unclear"))) == "current"


def test_mmr_gap_is_open_and_can_be_turned_off(spark):
    rows = [(1, i, 1.0 - i / 100, "v", i * 5, [1.0, 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "q int, id int, score double, video string, at int, v array<double>")
    pick = lambda gap: [r["id"] for r in diversity.mmr_select(df, "q", "id", "score", "video", "at", "v", 2, gap=gap).orderBy("pick").collect()]
    assert (pick(5), pick(6), pick(0)) == ([0, 1], [0, 2], [0, 1])


def test_bm25_blocks_pools_and_ties(spark, monkeypatch):
    from lodestream.operators import retrieval as bm

    docs = spark.createDataFrame([(i, "red fox" if i % 3 else "red red fox den", f"s{i % 2}") for i in range(40)] + [(99, None, "s0")], "d int, text string, s string")
    asks = spark.createDataFrame([(1, "fox den", ["s0"]), (2, "fox", None), (3, "fox", []), (4, None, ["s1"]), (5, "den", ["s1", "s0"])], "q int, text string, pool array<string>")
    found = []
    for size, cells in ((500, 4_000_000), (2, 3)):
        monkeypatch.setattr(bm, "BLOCK_QUERIES", size)
        monkeypatch.setattr(bm, "CHUNK_CELLS", cells)
        got = bm.bm25_best(docs.repartition(3), asks, "d", "q", 4, ["s"], source="s", pool="pool").collect()
        found.append(sorted((r["q"], r["rank"], r["d"], r["s"], r["score"]) for r in got))
    assert found[0] == found[1]
    assert {r[0] for r in found[0]} == {1, 2, 5} and all(r[3] == "s0" for r in found[0] if r[0] == 1)
    assert [r[2] for r in found[0] if r[0] == 2] == [1, 2, 4, 5]  # shorter texts first, then the least id
    assert [r[2] for r in found[0] if r[0] == 5] == [0, 3, 6, 9]


def test_vector_search_against_all_pairs(spark, monkeypatch):
    from lodestream.operators import vector_search as vs

    rng = random.Random(4)
    rows = [(i, i % 3, [round(rng.uniform(-1, 1), 2) for _ in range(4)]) for i in range(50)] + [(50, 0, [0.0] * 4), (51, 1, None)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    asks = df.filter("id % 10 = 0").select(F.col("id").alias("query"), "label", "vector")
    monkeypatch.setattr(vs, "CHUNK_ROWS", 7)
    monkeypatch.setattr(vs, "BLOCK_QUERIES", 2)
    got = vs.find_vectors(df.repartition(4), asks, [vs.Pick("near", 3), vs.Pick("far", 1, by="least", skip=("id", "label"))]).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for q, label, v in rows[:50:10]:
        pairs = [(round(cos(v, w), 6), i, k) for i, k, w in rows[:50] if i != q]
        near = sorted(pairs, key=lambda p: (-p[0], p[1]))[:3]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if (r["query"], r["pick"]) == (q, "near")] == [i for _, i, _ in near]
        far = min((p for p in pairs if p[2] != label), key=lambda p: (p[0], p[1]))
        assert [r["id"] for r in got if (r["query"], r["pick"]) == (q, "far")] == [far[1]]


def test_median_running_mean_and_numbers(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.choice([1.25, 1.25, 7.5, rng.uniform(0, 9)])) for i in range(301)] + [("b", i * 700, float(i)) for i in range(4)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    from statistics import mean, median

    values = {g: [v for x, _, v in rows if x == g and v is not None] for g in "ab"}
    assert {r["g"]: r["median"] for r in evaluate.exact_median(df, "g", "v").collect()} == {g: median(v) for g, v in values.items()}
    got = {(r["g"], r["i"]): r["mean"] for r in evaluate.running_mean(df.filter("v is not null"), "g", "i", F.col("v"), 50).collect()}
    assert all(abs(got[g, i] - mean([v for x, j, v in rows if x == g and j <= i])) < 1e-9 for g, i, v in rows if v is not None)
    ids = selection.numbered(spark.range(100), [F.col("id") % 7], [F.desc("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in ids] == list(range(1, 101)) and [r["id"] for r in ids] == sorted(range(100), key=lambda i: (i % 7, -i))


def test_more_parsing(spark):
    assert value(spark, ps.context_key(F.lit("DAY2_110942_11101508"))).asDict() == {"day": 2, "start_ms": 40182000, "end_ms": 40215080}
    assert value(spark, ps.context_key(F.lit("DAY2_110942"))) is None and value(spark, ps.context_key(F.lit("DAY2_116042_111015"))) is None
    assert value(spark, ps.caption_key(F.lit("DAY1_A3_ANN_1109420.mp4"))).asDict() == {"day": 1, "start_ms": 40182000, "end_ms": 40212000}
    assert value(spark, vec.gaussian_box_score(F.lit(3.0), F.lit(4.0), (-2, -2, 2, 2), 5.0)) == pytest.approx(0.6065306597)
    with pytest.raises(ValueError):
        vec.gaussian_box_score(F.lit(0.0), F.lit(0.0), (0, 0, 1, 1), 0)
    assert value(spark, tx.retrieval_tokens(F.lit("The cats' owner's boxes 'n a dog's walking walking"), ("the",), {"cats": "cat"})) == ["cat", "owner'", "boxes", "dog's", "walk", "walk"]
    assert value(spark, tx.choice_loose(F.lit("The correct answer is option C"), "abcd", ("the correct answer is", "answer:", "option"))) == 2




def test_running_values_over_many_partitions(spark):
    """One key holds nearly all rows; values are carried over the partitions its rows lie in."""
    from pyspark.sql import Window

    from lodestream.operators.ordered import PART, Running, running, stretched

    rows = [(None if i % 91 == 0 else 1 if i % 13 else 2, (i * 37) % 1000, i, None if i % 3 else i % 17) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int")
    keys, order = ["k"], ["t", "i"]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = stretched(df, keys, order)
        assert placed.filter("k = 1").select(PART).distinct().count() > 4
        v = F.col("v").cast("long")
        got = running(placed, keys, order, {
            "s": Running(v, "sum"), "b": Running(v, "sum", current=False), "m": Running(v, "max", current=False), "l": Running(F.col("v"), "last"), "p": Running(F.col("v"), "last", current=False), "n": Running(v, "total"),
        })
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    want = df.select(
        "k", "t", "i", "v", F.coalesce(F.sum("v").over(upto), zero), F.coalesce(F.sum("v").over(earlier), zero), F.max("v").over(earlier), F.last("v", True).over(upto), F.last("v", True).over(earlier), F.sum("v").over(Window.partitionBy("k")),
    )
    assert sorted(map(str, map(tuple, got.select("k", "t", "i", "v", "s", "b", "m", "l", "p", "n").collect()))) == sorted(map(str, map(tuple, want.collect())))
    with pytest.raises(ValueError):
        running(placed, keys, order, {"x": Running(v, "mode")})

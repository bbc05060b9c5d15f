"""Readers, writers and streaming forms on files written here."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.sources import readers, writers
from lodestream.streaming import events as st


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1, "v": "x"},\n {"k": 2}]')
    assert [(r["k"], r["v"]) for r in readers.read_json(spark, f"{tmp_path}/a.json", "k int, v string").orderBy("k").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n  \n{"k": 2}\n')
    assert readers.read_jsonl(spark, f"{tmp_path}/b.jsonl", "k int", strict=True).agg(F.sum("k")).first()[0] == 3
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, f"{tmp_path}/c.jsonl", "k int", strict=True).collect()
    assert readers.read_jsonl(spark, f"{tmp_path}/c.jsonl", "k int").count() == 2


def test_text_tables_and_sentinels(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,UNKNOWN\n')
    df = readers.read_csv(spark, f"{tmp_path}/t.csv", ["id", "text"])
    assert dict(df.dtypes) == {"id": "string", "text": "string"}
    assert [r["text"] for r in readers.without_sentinels(df, "text").orderBy("id").collect()] == ['two\nlines, "quoted"', None]
    (tmp_path / "t.tsv").write_text("id\ttext\n7\ta b\n")
    assert readers.read_tsv(spark, f"{tmp_path}/t.tsv").first().asDict() == {"id": "7", "text": "a b"}
    (tmp_path / "ids.txt").write_text("# head\n\nx1 note\n x2\n")
    assert sorted(r["id"] for r in readers.read_list(spark, f"{tmp_path}/ids.txt").collect()) == ["x1", "x2"]


def test_directories(spark, tmp_path):
    for name, body in (("1.json", {"a": "old", "b": "x"}), ("2.json", {"a": "new"})):
        (tmp_path / "maps").mkdir(exist_ok=True)
        (tmp_path / "maps" / name).write_text(json.dumps(body))
    assert {(r["key"], r["value"]) for r in readers.read_json_maps(spark, f"{tmp_path}/maps").collect()} == {("a", "new"), ("b", "x")}
    clips = tmp_path / "clips" / "skipme"
    clips.mkdir(parents=True)
    (clips.parent / "DAY1_A2_11000000.mp4").write_text("x")
    (clips / "DAY1_A3_11000000.mp4").write_text("x")
    (clips.parent / "frame.JPG").write_text("x")
    found = readers.list_files(spark, f"{tmp_path}/clips", r"DAY(\d+)_A(\d+)_(\d{8})\.mp4$", ("day", 1, "int"), ("agent", 2, "int"))
    assert sorted((r["day"], r["agent"]) for r in found.collect()) == [(1, 2), (1, 3)]
    media = readers.media_index(spark, f"{tmp_path}/clips", {"video": ["mp4"], "image": ["jpg"]}, skip=["skipme"])
    assert {(r["name"], r["kind"]) for r in media.collect()} == {("day1_a2_11000000.mp4", "video"), ("frame.jpg", "image")}
    group = tmp_path / "runs" / "JAKE_ALICE"
    group.mkdir(parents=True)
    (group / "summary.json").write_text('{"accuracy": 0.5}')
    row = readers.read_summaries(spark, f"{tmp_path}/runs/*/summary.json", "accuracy double").first()
    assert (row["agent_group"], row["agent_count"], row["accuracy"]) == ("JAKE_ALICE", 2, 0.5)


def test_one_row(spark):
    df = spark.range(3)
    assert readers.one_row(df, F.col("id") == 1).first()["id"] == 1
    with pytest.raises(Exception, match="exactly one"):
        readers.one_row(df, F.col("id") > 0).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", ["x", "y"], (True, 2))], "id int, text string, tags array<string>, d struct<ok:boolean,n:int>")
    writers.write_csv(df, f"{tmp_path}/c", ["id", "text", "none"])
    assert readers.read_csv(spark, f"{tmp_path}/c", ["id", "text", "none"]).first().asDict() == {"id": "1", "text": "a\\nb", "none": None}
    writers.write_flat_csv(df, f"{tmp_path}/f", {"ok": "d.ok", "tags": "tags", "d": "d"})
    assert readers.read_csv(spark, f"{tmp_path}/f", ["ok", "tags", "d"]).first().asDict() == {"ok": "true", "tags": "x;y", "d": '{"ok":true,"n":2}'}
    for append in (False, True):
        writers.write_jsonl(df.select("id"), f"{tmp_path}/j", append)
    assert readers.read_jsonl(spark, f"{tmp_path}/j", "id int").count() == 2
    writers.write_index(spark.createDataFrame([("a", 1), ("b", 2)], "term string, doc int"), f"{tmp_path}/i", buckets=4)
    assert spark.read.parquet(f"{tmp_path}/i").filter("term = 'b'").first()["doc"] == 2
    assert writers.markdown_table(df.select("id")) == "| id |\n|---|\n| 1 |"


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = st.read_folder(spark, f"{tmp_path}/in", "event_id long, ts timestamp, event_type string", files_per_batch=10)
    st.append_files(st.first_of_key(stream, "ts", ["event_id"]), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == events.count()
    st.summarise_each_batch(stream, lambda b: b.groupBy("event_type").count(), f"{tmp_path}/sum", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sum").agg(F.sum("count")).first()[0] == events.count()
    counts = st.windowed_counts(stream, "ts", "event_type")
    counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = events.groupBy(F.window("ts", "10 minutes"), "event_type").count()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0]
    assert spark.table("windowed").count() == batch.count()
    st.sessions(stream, "ts", "event_type").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert set(spark.table("sessions").columns) == {"start", "end", "event_type", "n"}


def test_entries_and_transcripts_hold_whole_texts(spark, tmp_path):
    from lodestream.plans.catalog import QUERIES

    text = "a caption of more than thirty characters, to its end"
    spark.createDataFrame([(1, 0, "user", text), (1, 1, "bot", text)], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    entries = {r["key"]: r["entry"] for r in QUERIES["nested_explode_concat"](spark, str(tmp_path)).collect()}
    assert entries == {"1-0": f"user: {text}", "1-1": f"bot: {text}"}
    [row] = QUERIES["ordered_string_agg"](spark, str(tmp_path)).collect()
    assert row["transcript"] == f"[0] user: {text}\n[1] bot: {text}"


def test_saved_index_is_read_by_buckets(spark, tmp_path):
    from lodestream.functions import text as tx
    from lodestream.operators.retrieval import postings

    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox")], "d int, text string")
    writers.write_index(postings(docs, "d", tx.alnum_tokens("text")), f"{tmp_path}/index")
    found = readers.read_index(spark, f"{tmp_path}/index", ["red", "fox", "none"])
    assert sorted((r["term"], r["d"], r["tf"], r["length"]) for r in found.collect()) == [("fox", 1, 1, 3), ("fox", 2, 1, 2), ("red", 1, 2, 3)]
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert readers.read_index(spark, f"{tmp_path}/index", []).count() == 0


def test_html_report(spark):
    page = writers.html_table(spark.createDataFrame([("a<b", None)], "x string, y string"), "T & co")
    assert "<title>T &amp; co</title>" in page and "<td>a&lt;b</td><td></td>" in page and "<th>x</th>" in page


def test_bad_lines_are_numbered(spark, tmp_path):
    """Numbers hold in files that are read in several splits; every kind of bad line is told apart."""
    from lodestream.sources.lines import BadLine, read_lines, read_lines_strict

    bad = {3: '{"a": 1', 5: "[1]", 6: '[{"a": 1}]', 8: '{"a": "x"}', 9: '{"a": 1} {"a": 2}', 10: "{'a': 1}", 11: "nonsense", 12: "{}, {}", 700: "7"}
    blank = {2: "", 4: "   "}
    lines = [bad.get(i, blank.get(i, '{"a": %d, "b": "%s", "more": [1]}' % (i, "x" * 40))) for i in range(1, 1001)]
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text('{"a": 1}\nbroken')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = read_lines(spark, str(tmp_path), "a long, b string")
        got = {(r["path"].rsplit("/", 1)[1], r["line"]): r for r in read.quarantine.collect()}
        assert set(got) == {("one.jsonl", n) for n in bad} | {("two.jsonl", 2)}
        reasons = {n: got["one.jsonl", n]["reason"] for n in bad}
        assert [reasons[n] for n in (3, 9, 10, 11, 12)] == ["invalid JSON row"] * 5
        assert [reasons[n] for n in (5, 6, 700)] == ["expected JSON object"] * 3 and "type" in reasons[8]
        assert got["one.jsonl", 700]["text"] == "7"
        assert read.rows.count() == 1000 - len(bad) - len(blank) + 1
        with pytest.raises(BadLine, match=r"one\.jsonl:3: invalid JSON row"):
            read_lines_strict(spark, str(tmp_path), "a long, b string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "x.jsonl").write_text('\n{"a": 1}\n{"b": "y"}\n')
    assert [tuple(r) for r in read_lines_strict(spark, f"{tmp_path}/good", "a long, b string").collect()] == [(1, None), (None, "y")]

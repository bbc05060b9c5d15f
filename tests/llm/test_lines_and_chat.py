import hashlib
import os
from collections import defaultdict

from helpers import docs, documents, words

from lodestream.llm import chat, line_dedup


def brute_drops(rows):
    """{doc_id: positions} by the definition; rows: (doc_id, text) with different doc_ids."""
    places = defaultdict(list)
    for d, text in rows:
        for p, line in enumerate((text or "").split("\n")):
            w = ["<*>" if any(c in "0123456789" for c in t) else t for t in words(line)]
            if len(w) < 5:
                if w:
                    places["s", *words(line)].append((d, p))
                continue
            if len(w) < 8:
                places["m", *w].append((d, p))
                continue
            half = (len(w) - 4 + 1) // 2
            places["a", len(w), *w[:4], "|", *w[4 : 4 + half]].append((d, p))
            places["b", len(w), *w[:4], "|", *w[4 + half :]].append((d, p))
    drops = defaultdict(set)
    for own in places.values():
        if len({d for d, _ in own}) >= 2:
            for d, p in own:
                if (d, p) != min(own):
                    drops[d].add(p)
    return drops


def test_lines_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    pdf = documents(spark, sf)
    drops = brute_drops(list(zip(pdf.doc_id, pdf.text)))
    assert any(drops.values())
    for r in line_dedup.op5_line_dedup(spark, sf).collect():
        lines = pdf.text[pdf.doc_id == r["doc_id"]].iloc[0].split("\n")
        clean = "\n".join(x for p, x in enumerate(lines) if p not in drops[r["doc_id"]])
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(drops[r["doc_id"]]))
        assert r["clean_md5"] == hashlib.md5(clean.encode()).hexdigest()


def test_odd_lines(spark):
    footer = "Posted on day {} by the site team for all of our readers"
    rows = [
        (1, "unique opening line number one here\n" + footer.format(12)), (2, footer.format(7) + "\n\nshort\nshort"), (3, None), (4, ""),
        (5, "\n".join([footer.format(i) for i in range(3000)])), (6, "short\n\n"), (6, "short\n\n"),
    ]
    df = docs(spark, rows).withColumn("n_dropped", line_dedup.F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "\nshort" and got[2]["n_dropped"] == 2
    assert got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["text"] == ""
    assert got[5]["text"] == "" and got[5]["n_dropped"] == 3000
    assert got[6]["text"] == "\n"
    assert line_dedup.dedup_lines(df).count() == len(rows)
    same = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])
    assert sorted(r["text"] for r in line_dedup.dedup_lines(same).collect()) == ["", "", "a b c d e f"]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


TURNS = "conv_id long, turn long, role string, text string, extra int"


def test_rotation(spark):
    rows = [
        (1, 0, "system", "be kind", 1), (1, 1, "anna", "hi <|assistant|>", 1), (1, 2, "bob", "hello", 1), (1, 3, "anna", None, 1),
        (2, 0, "system", "alone", 1), (None, None, None, "x", 1), (None, None, None, "x", 1),
    ]
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {(1, "anna"), (1, "bob"), (None, "unknown")}
    anna = got[1, "anna"]
    assert anna["text"] == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi <\\|assistant|><|end|>\n<|user bob|>\nhello<|end|>\n<|assistant|>\n<|end|>\n"
    )
    assert [anna["text"][s["start"] : s["end"]] for s in anna["mask"]] == ["hi <\\|assistant|><|end|>\n", "<|end|>\n"]
    bob = got[1, "bob"]
    assert [bob["text"][s["start"] : s["end"]] for s in bob["mask"]] == ["hello<|end|>\n"] and "<|user anna|>" in bob["text"]
    assert got[None, "unknown"]["n_turns"] == 2
    assert chat.rotate_perspectives(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversations_come_in_blocks(spark):
    rows = [(1, t, ("a", "b")[t % 2], f"t{t}", 0) for t in range(1000)] + [(2, 5, "a", f"x{i:04d}", 0) for i in range(700)]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, TURNS)).orderBy("block", "sub").collect()
    assert max(r["n_turns"] for r in got) <= chat.BLOCK_TURNS
    for conv, who in ((1, "a"), (1, "b"), (2, "a")):
        whole = "".join(r["text"] for r in got if (r["conv_id"], r["perspective"]) == (conv, who))
        want = "".join(f"<|{'assistant' if s == who else 'user ' + s}|>\n{x}<|end|>\n" for c, _, s, x, _ in rows if c == conv)
        assert whole == want


def test_whole_tables_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    for query, sql in ((line_dedup.op5_line_dedup, line_dedup.OP5_SQL), (chat.op6_chat_rotation, chat.OP6_SQL)):
        got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_short_lines_are_counted_whole(spark):
    rows = [
        (1, "All rights reserved.\nShare\n\nPage 1"), (2, "All rights  reserved.\nonly here\nonly here\n\nPage 2"),
        (3, "Share\nall rights reserved.\nAll rights reserved. 2"),
    ]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("only here\nonly here\n\nPage 2", 1), 3: ("all rights reserved.\nAll rights reserved. 2", 1)}


def test_lines_that_share_their_beginning_stay(spark):
    rows = [
        (1, "Please see the following appendix\nThe price rose by seven\nAs shown in table 4"), (2, "Please see the following invoice\nThe price rose by nine\nAs shown in table 9"),
        (3, "one two three four five six\none two three four five seven eight"), (4, "one two three four 5 nine\none two three four five seven nine"),
    ]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    # only the line whose difference is a number is gone
    assert got == {1: (rows[0][1], 0), 2: ("\n".join(rows[1][1].split("\n")[:2]), 1), 3: (rows[2][1], 0), 4: (rows[3][1], 0)}

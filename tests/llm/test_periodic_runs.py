import hashlib
import zlib

import numpy as np
import pytest
from helpers import docs, documents, words, write_tables
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import periodic_runs as pr


def brute_runs(w, least):
    """(begin, end, smallest period) of all runs, by comparing the sequence with itself at every distance."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((b, e, q) for (b, e), q in best.items())


def brute(rows):
    out = {}
    for doc_id, text in rows:
        w = words(text)
        n = len(w)
        if n and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
            g = zlib.crc32(str(doc_id).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = sorted(((b, e - b, q) for b, e, q in brute_runs(w, 12)), key=lambda r: (r[0], r[2]))
        dropped = {i for b, m, q in runs for i in range(b + q, b + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{b},{m},{q}\n" for b, m, q in runs)
        clean = " ".join(x for i, x in enumerate(w) if i not in dropped)
        out[doc_id] = (
            len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest(),
        )
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=48), st.sampled_from([2, 3, 5, 12]))
def test_every_run_of_short_sequences(s, least):
    assert pr.runs_of(s, least) == brute_runs(s, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=7), st.integers(1, 6)), max_size=12))
def test_every_run_of_repetitive_sequences(parts):
    s = [x for part, times in parts for x in part * times]
    assert pr.runs_of(s, 12) == brute_runs(s, 12)


def test_factors_have_an_earlier_occurrence():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 3, 400).tolist() + [9] + rng.integers(0, 3, 50).tolist()
    parts = pr.factors(s)
    assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == len(s)
    for begin, end, earlier in parts:
        if earlier < 0:
            assert end == begin + 1 and s[begin] not in s[:begin]
        else:
            assert earlier < begin and s[earlier : earlier + end - begin] == s[begin:end]


def test_long_sequences_take_linear_time():
    s = list(range(997)) * 200  # one run, nothing is compared with itself at every distance
    assert pr.runs_of(s, 12) == [(0, len(s), 997)]
    a, b = [0], [0, 1]  # a Fibonacci word has about 0.76 runs a letter
    while len(b) < 20_000:
        a, b = b, b + a
    found = pr.runs_of(b, 2)
    assert 0.7 * len(b) < len(found) < 0.8 * len(b)


def test_whole_table_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    pdf = documents(spark, sf)
    got = {r["doc_id"]: tuple(r)[1:] for r in pr.op11_periodic_runs(spark, sf).collect()}
    want = brute([(d, t) for d, t in zip(pdf.doc_id, pdf.text) if len(words(t)) < 1500])
    assert len(got) == len(pdf) and len(want) > 900
    assert {d: got[d] for d in want} == want
    assert sum(v[0] > 0 for v in want.values()) > 50


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 60_000)) + " tick tock" * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 40), (5, "a\x0bb\n" * 30), (None, "x y z " * 10), (6, "no run here"), (7, "é ü ß " * 9), (7, "é ü ß " * 9), (8, long)]
    df = docs(spark, rows).withColumn("runs", pr.F.lit("clash")).withColumn("collapsed", pr.F.lit(1))
    got = pr.find_runs(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "n_words", "runs", "collapsed"} or "n_chars" not in df.columns
    by_text = {r["text"]: ([(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"], r["n_words"]) for r in got}
    assert by_text[None] == ([], "", 0) and by_text[""] == ([], "", 0) and by_text[" \n\t "] == ([], "", 0)
    assert by_text["a " * 40] == ([(0, 40, 1)], "a", 40)
    assert by_text["a\x0bb\n" * 30] == ([(0, 60, 2)], "a b", 60)
    assert by_text["é ü ß " * 9] == ([(0, 18, 2)], "é ü ß", 18)
    assert by_text["no run here"] == ([], "no run here", 3)
    assert by_text[long][0][-1] == (60_000, 40_000, 2) and len(by_text[long][1].split()) == 60_002
    assert len(got) == len(rows)
    folder = write_tables(spark, tmp_path, documents=docs(spark, rows))
    short = [r for r in rows if r[0] != 8]
    want = brute(short)
    assert {r["doc_id"]: tuple(r)[1:] for r in pr.op11_periodic_runs(spark, folder).filter("doc_id IS NULL OR doc_id <> 8").collect()} == want
    assert pr.find_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pr.find_runs(df, min_length=1)

import hashlib
import random
import zlib

import duckdb
import pytest
from helpers import words, write_tables

from lodestream.llm import prefix_trie as pt
from lodestream.llm import url_filter as uf

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    convs = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    nodes = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if k in children else 1
        saved[k] = sum(saved[x] for x in children.get(k, [])) + (len(nodes[k]) - 1) * (len(words(k[-1][1])) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in pt.op12_prefix_trie(spark, str(folder)).collect()), key=str)


def written(spark, tmp_path, rows):
    return write_tables(spark, tmp_path, conversations=spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS digest"))


@pytest.mark.parametrize("block", [256, 2])
def test_random_conversations(spark, tmp_path, monkeypatch, block):
    """Few texts, so many prefixes are shared; blocks of two make several levels of chains."""
    monkeypatch.setattr(pt, "BLOCK", block)
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", ""])) for c in rng.sample(range(300), 120) for t in range(rng.randrange(1, 19))]
    rows += [(500, t, "user", "one more turn") for t in range(40)]
    assert got(spark, written(spark, tmp_path, rows)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        (0, None, "user", "first"), (0, 5, None, None), (0, 5, "user", "tie"), (0, 5, "user", "tie"), (1, 0, "user", "only"), (2, None, None, ""), (3, 1, "", None),
        (None, 0, "user", "no conversation"), (19, 2, "user", "x " * 50_000), (40, 0, "usera", "b"), (41, 0, "user", "ab"), (47, 0, "user", "first"), (67, 3, "é", "ü"), (-1, 0, "user", "first"), (-20, 0, "user", "neg"),
    ]
    rows += [(c, 0, "user", "copy") for c in range(1000, 1300)]
    want = brute([(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0])
    assert got(spark, written(spark, tmp_path / "a", [r for r in rows if r[0] is None or r[0] >= 0])) == want
    assert len(got(spark, written(spark, tmp_path / "b", rows))) > len(want)
    assert got(spark, written(spark, tmp_path / "c", [])) == []
    assert got(spark, written(spark, tmp_path / "d", [(None, 1, "user", "x")])) == []


def test_a_long_conversation_is_linear(spark, tmp_path):
    """3000 turns in one conversation and a copy of it: as many rows as turns."""
    rows = [(c, t, "user", f"w {t % 7}") for c in (7, 27) for t in range(3000)]
    assert got(spark, written(spark, tmp_path, rows)) == brute(rows)


@pytest.mark.parametrize("name, query, sql", [("op12", pt.op12_prefix_trie, pt.OP12_SQL), ("op13", uf.op13_url_filter, uf.OP13_SQL)])
def test_whole_tables_against_sql(spark, sf_dir, name, query, sql):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    rows = query(spark, sf_dir).select(*columns).collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted(want.fetchall(), key=str)
    assert len(rows) >= 50

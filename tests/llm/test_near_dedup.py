import random
from collections import Counter

import numpy as np
from helpers import docs, documents, words

from lodestream.llm import near_dedup as nd


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = (a & b).total()
    return both / (a.total() + b.total() - both) if a or b else 0.0


def brute_classes(rows):
    """Least doc_id of the class of every row, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle, by_text = {}, {}
    for i, s in enumerate(sets):
        for g in s:
            by_shingle.setdefault(g, []).append(i)
        by_text.setdefault(rows[i][1], []).append(i)
    pairs = {(g[0], j) for g in by_text.values() for j in g[1:]}
    pairs |= {(i, j) for g in by_shingle.values() for i in g for j in g if i < j}
    for i, j in pairs:
        if rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= 0.8:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    classes = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            classes[r] = min(classes.get(r, doc_id), doc_id)
    return [classes.get(find(i)) for i in range(len(rows))]


def test_whole_table_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    pdf = documents(spark, sf)
    want = dict(zip(pdf.doc_id, brute_classes(list(zip(pdf.doc_id, pdf.text)))))
    got = {r["doc_id"]: r["class_id"] for r in nd.op4_near_dedup(spark, sf).collect()}
    assert got == want


def test_signatures_agree_like_the_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    weights = rng.integers(1, 6, 400).astype(float)
    doc, element, weight = [], [], []
    for d, (low, high) in enumerate([(0, 300), (40, 340), (0, 3)]):
        doc += [d] * (high - low)
        element += list(pool[low:high])
        weight += list(weights[low:high])
    sig = nd.dart_minhash(np.array(doc), np.array(element, np.uint64), np.array(weight), 3, 2048)
    true = weights[40:300].sum() / weights[:340].sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    small = weights[:3].sum() / weights[:300].sum()
    assert abs((sig[0] == sig[2]).mean() - small) < 0.02
    assert (sig != 0).all()


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150", "x150")
    far = " ".join(f"w{i}" for i in range(150)) + " " + " ".join(f"y{i}" for i in range(150))
    rows = [(5, base), (3, near), (9, base), (9, base), (None, base), (1, far), (7, None), (6, None), (8, ""), (2, "a b"), (4, "a b"), (10, " "), (None, "alone")]
    df = docs(spark, rows).withColumn("class_id", nd.F.lit("clash")).withColumn("tid", nd.F.lit(1))
    got = nd.label_near_duplicates(df).collect()
    want = [(5, 3), (3, 3), (9, 3), (9, 3), (None, 3), (1, 1), (7, 6), (6, 6), (8, 8), (2, 2), (4, 2), (10, 10), (None, None)]
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter(want)
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "1", "6", "8", "2", "10", "None"])
    assert nd.label_near_duplicates(docs(spark, [])).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    origin = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(90):
        w = list(origin)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{d}_{rng.random()}"
        rows.append((d, " ".join(w)))
    monkeypatch.setattr(nd, "TILE_TEXTS", 7)
    got = {r["doc_id"]: r["class_id"] for r in nd.label_near_duplicates(docs(spark, rows)).collect()}
    assert [got[d] for d, _ in rows] == brute_classes(rows)


def test_families_over_many_tiles(spark, monkeypatch):
    """Two families and texts that hang between them, over many small tiles: groups grow with the texts, not with their pairs."""
    monkeypatch.setattr(nd, "TILE_TEXTS", 8)
    monkeypatch.setattr(nd, "SENT_TO", 3)
    compared, real = [], nd._links
    monkeypatch.setattr(nd, "_links", lambda texts, wanted, *rest: compared.append(wanted.select(nd.F.explode("groups.group")).distinct().count()) or real(texts, wanted, *rest))
    groups = []
    for n in (100, 300):
        rng = random.Random(11)
        rows = []
        for f in range(2):
            origin = [f"f{f}_{i}" for i in range(100)]
            for d in range(n):
                w = list(origin)
                for _ in range(1 + (d % 10 == 0)):
                    w[rng.randrange(len(w))] = f"e{f}_{d}_{rng.random()}"
                rows.append((1000 * f + d, " ".join(w)))
            rows += [(1000 * f + 500 + d, " ".join(origin[: 100 - 7 * d] + [f"tail{d}_{i}" for i in range(7 * d)])) for d in range(1, 6)]
        compared.clear()
        got = {r["doc_id"]: r["class_id"] for r in nd.label_near_duplicates(docs(spark, rows)).collect()}
        assert [got[d] for d, _ in rows] == brute_classes(rows)
        groups.append(sum(compared))
    assert groups[1] < 5 * groups[0]  # nine times as many pairs of tiles


def test_ids_never_join_classes(spark):
    """Different texts stay whatever their doc_ids; of rows equal in doc_id and text one stays."""
    base = [" ".join(f"{p}{i}" for i in range(60)) for p in "abcdef"]
    near = base[0].replace("a30", "x30")
    rows = [(None, base[0]), (None, base[1]), (None, base[2]), (7, base[3]), (7, base[4]), (8, near), (9, base[5]), (9, base[5]), (None, base[5])]
    df = docs(spark, [(i, t, "en", f"s{n}") for n, (i, t) in enumerate(rows)])
    kept = nd.drop_near_duplicates(df).collect()
    assert Counter(r["text"] for r in kept) == Counter([base[1], base[2], base[3], base[4], near, base[5]])
    assert [r["doc_id"] for r in kept if r["text"] == base[5]] == [9]
    all_null = docs(spark, [(None, t) for t in base] + [(None, base[0])])
    assert Counter(r["text"] for r in nd.drop_near_duplicates(all_null).collect()) == Counter(base)


def test_one_row_of_each_class_is_kept(spark, tmp_path):
    from helpers import write_tables

    a, b = ("p q r s t u v " * 3, "k l m n o p")
    folder = write_tables(spark, tmp_path, documents=docs(spark, [(1, a), (1, a), (2, a), (1, b), (None, "z y x w v"), (None, "z y x w v")]))
    got = nd.op4_near_dedup(spark, folder).collect()
    assert Counter((r["class_id"], r["class_size"]) for r in got if r["kept"]) == Counter([(1, 3), (1, 1), (None, 2)])
    assert len(got) == 6


def test_common_items_and_forest():
    rng = np.random.default_rng(1)
    n = 60
    has = rng.random((n, 500)) < np.where(np.arange(500) < 60, 0.8, 0.03)
    owner, item = np.nonzero(has)
    shuffled = rng.permutation(len(owner))
    got = nd.common_items(owner[shuffled], item[shuffled], n)
    want = has.astype(int) @ has.T.astype(int)
    np.fill_diagonal(want, 0)
    np.fill_diagonal(got, 0)
    assert (got == want).all()
    near = np.zeros((7, 7), bool)
    for i, j in [(0, 5), (5, 3), (3, 6), (1, 4)]:
        near[i, j] = near[j, i] = True
    assert nd.forest(near).tolist() == [0, 1, 2, 0, 1, 0, 0]


def test_classes_do_not_depend_on_the_layout(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = [sorted((r["doc_id"], r["class_id"]) for r in nd.label_near_duplicates(df.repartition(n)).collect()) for n in (1, 8)]
    assert found[0] == found[1]

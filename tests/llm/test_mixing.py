import hashlib
from collections import defaultdict

import pytest
from helpers import docs, documents, words

from lodestream.llm import mixing as mx


def brute_targets(sizes):
    """{source: target}: shares by weight, excess reshared round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped, left = {}, set(), sum(sizes.values())
    while len(capped) < len(order):
        free = [s for s in order if s not in capped]
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            capped.add(s)
    return target


def number(doc_id):
    key = f"{mx.SEED}|" + ("\\N" if doc_id is None else str(doc_id))
    return (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute_mix(rows):
    """{doc_id: (target, copies)} by sorting every source whole; rows: (doc_id, size, source)."""
    sizes, groups, out = defaultdict(int), defaultdict(list), {}
    for d, n, s in rows:
        sizes[s] += n
        groups[s].append((number(d), d, n))
    targets = brute_targets(sizes)
    for s, group in groups.items():
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest = targets[s] - whole * sizes[s]
        rounded = {n: n >> max(n.bit_length() - 10, 0) << max(n.bit_length() - 10, 0) for _, _, n in group}
        certain, free = [], sorted((g for g in group if g[2]), key=lambda g: rounded[g[2]])
        while free:  # whoever would be drawn with certainty is taken first
            left = rest - sum(n for _, _, n in certain)
            scale = left / sum(rounded[n] * n for _, _, n in free)
            if scale * rounded[free[-1][2]] < 1:
                break
            most = rounded[free[-1][2]]
            certain += [g for g in free if rounded[g[2]] == most]
            free = [g for g in free if rounded[g[2]] < most]
        for _, d, _ in group:
            out[d] = (targets[s], whole)
        if rest <= 0 or not free:
            continue
        for _, d, _ in certain:
            out[d] = (targets[s], whole + 1)

        def place(g):
            p = scale * rounded[g[2]]
            ratio = (g[0] / (1 - g[0])) / (p / (1 - p))
            return ratio / (1 + ratio)

        if left <= 0:
            continue
        ordered, taken = sorted(free, key=lambda g: (place(g), g[1] or 0, g[2])), []
        for _ in range(2):  # in order, as long as they fit; then those no larger than the rest
            small = [g for g in ordered if g not in taken and g[2] <= (left if taken or _ else 10**18)]
            reached, fitting = 0, []
            for g in small:
                reached += g[2]
                if reached > left:
                    break
                fitting.append(g)
            all_small = len(fitting) == len(small)
            taken += fitting
            left -= sum(g[2] for g in fitting)
        for _ in range(0 if all_small else 2):  # the largest that fit
            rest = [g for g in ordered if g not in taken and g[2] <= left]
            if rest:
                taken.append(max(rest, key=lambda g: (g[2], -place(g))))
                left -= taken[-1][2]
        for _, d, _ in taken:
            out[d] = (targets[s], whole + 1)
    return out


def test_whole_table_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    pdf = documents(spark, sf)
    want = brute_mix([(d, len(words(t)), s) for d, t, s in zip(pdf.doc_id, pdf.text, pdf.source)])
    rows = mx.op7_mixing(spark, sf).collect()
    assert len(rows) == len(pdf)
    taken, target = defaultdict(int), {}
    for r in rows:
        assert (pytest.approx(r["target"]), r["copies"]) == want[r["doc_id"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 1)


def test_probabilities_follow_sizes(spark):
    """Over many draws a document is taken about as often as its inclusion probability says."""
    rows = [(i, 10 + 10 * (i % 4), "a", None) for i in range(24)] + [(100 + i, 40, "b", None) for i in range(24)]
    found = defaultdict(int)
    for seed in range(12):
        df = spark.createDataFrame([(200 * seed + d, n, f"{s}{seed}") for d, n, s, _ in rows], "doc_id long, size long, source string")
        lengths = df.select(mx.F.col("source").alias("__ls_src"), "doc_id", "size")
        targets = df.groupBy("source").agg(mx.F.sum("size").alias("source_size")).withColumn("target", mx.F.col("source_size") * 0.4)
        by_size = lengths.groupBy("__ls_src", mx.F.col("size").alias("__ls_w")).agg(mx.F.sum("size").alias("__ls_words"))
        plan = {r["__ls_name"]: r for r in mx.inclusion_plan(by_size, targets).collect()}
        for name, r in plan.items():
            own = [n for _, n, s, _ in rows if f"{s}{seed}" == name]
            expected = sum(min(1, r["__ls_scale"] * n) * n for n in own)
            assert expected == pytest.approx(0.4 * sum(own)) and r["__ls_scale"] * max(own) < 1
            found[name[0]] += 1
    assert found == {"a": 12, "b": 12}


def test_few_blocks_give_the_same_draw(spark):
    rows = [(i, (i * 37) % 90, "abc"[i % 3]) for i in range(400)] + [(1000, 5000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string")
    want = brute_mix(rows)
    for blocks in (1, 3, 2048):
        got = {r["doc_id"]: r["copies"] for r in mx.mix(df, "size", blocks=blocks).collect()}
        assert got == {d: c for d, (_, c) in want.items()}


def test_some_of_many_equal_rows(spark):
    rows = [(7, 10, "a")] * 60 + [(7, 10, "b")] * 3 + [(i, 1, "c") for i in range(400)]
    got = mx.mix(spark.createDataFrame(rows, "doc_id long, size long, source string"), "size").collect()
    assert len(got) == len(rows)
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 5}, {"a": 1, "b": 1000, None: 3}, {"a": 0, "b": 7}, {"z": 4}, {"a": 1, "b": 1, "c": 1, "d": 9999, "e": 2}])
def test_targets_against_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mx.source_targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None, None, "a"), (2, "", None, None), (3, "w " * 400, None, "a"), (3, "w " * 400, None, "a"), (None, "x y", None, None), (5, "one", None, "b")]
    df = docs(spark, rows).withColumn("copies", mx.F.lit("clash")).withColumn("target", mx.F.lit("clash"))
    sized = df.withColumn("size", mx.word_count(mx.text_or_empty("text")))
    for limit in (mx.BROADCAST_SOURCES, 1):  # by broadcast and by shuffle
        monkeypatch.setattr(mx, "BROADCAST_SOURCES", limit)
        got = mx.mix(sized, "size").collect()
        assert len(got) == len(rows)
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert mx.mix(sized.filter("false"), "size").count() == 0

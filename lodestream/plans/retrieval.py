"""Retrieval and similarity queries: BM25 in its forms, cosine, MMR, token overlap, geometry."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import retrieval as bm
from ..operators.diversity import mmr_select
from ..operators.vector_search import Pick, find_vectors
from ..sources.tables import load
from .registry import query

#: Frequent words of the test tables; a dictionary is a parameter of every operator that needs one.
STOPWORDS = ("the", "of", "and", "to", "a", "in")

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+', 0)"
_BM25_SQL = f"""
WITH d AS (SELECT doc_id, source, {_TOKENS} AS toks FROM documents),
q AS (SELECT item_id, term, least(count(*), 3) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, source, term, count(*) AS tf, any_value(len) AS len FROM
  (SELECT doc_id, source, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY doc_id, source, term),
s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT item_id, doc_id, source, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id, source)
"""


def _best(spark: SparkSession, sf_dir: str, k: int, *carry: str) -> DataFrame:
    docs, questions = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    return bm.bm25_best(docs, questions, "doc_id", "item_id", k, carry)


@query("bm25_topk", _BM25_SQL + """
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 5""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every question."""
    return _best(spark, sf_dir, 5)


@query("bm25_per_entity_topk", _BM25_SQL + """
, g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS overall FROM r),
e AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY overall) AS rank FROM g WHERE overall <= 1000)
SELECT item_id, source, doc_id, score, overall::INTEGER AS overall, rank::INTEGER AS rank FROM e WHERE rank <= 5 AND score >= 20""")
def bm25_per_entity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question and source the five best of the first 1000 hits; the score threshold comes after."""
    ranked = _best(spark, sf_dir, 1000, "source").withColumnRenamed("rank", "overall")
    best = bm.top_k(ranked, ["item_id", "source"], 5, F.col("overall"))
    return best.filter(F.col("score") >= 20).select("item_id", "source", "doc_id", "score", "overall", "rank")


@query("bm25_pool", f"""
WITH d AS (SELECT doc_id, source, {_TOKENS} AS toks FROM documents),
q0 AS (SELECT item_id, 'src' || (item_id % 20) AS source, {_TOKENS} AS toks FROM benchmark),
q AS (SELECT item_id, source, term, least(count(*), 3) AS qtf FROM (SELECT item_id, source, unnest(toks) AS term FROM q0) GROUP BY ALL),
p AS (SELECT doc_id, source, term, count(*) AS tf, any_value(len) AS len FROM
  (SELECT doc_id, source, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY doc_id, source, term),
s AS (SELECT source, count(*) AS n, avg(len(toks)) AS mean FROM d GROUP BY source),
f AS (SELECT source, term, count(*) AS df FROM p GROUP BY source, term),
r AS (SELECT item_id, source, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM p JOIN f USING (source, term) JOIN q USING (source, term) JOIN s USING (source) GROUP BY item_id, source, doc_id)
SELECT item_id, source, doc_id, score, rank::INTEGER AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def bm25_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents with a positive score in each question's pool, by the pool's statistics."""
    own = F.concat(F.lit("src"), F.col("item_id") % 20)
    questions = load(spark, sf_dir, "benchmark").withColumn("pool", F.array(own))
    best = bm.bm25_best(load(spark, sf_dir, "documents"), questions, "doc_id", "item_id", 10, source="source", pool="pool")
    return best.select("item_id", own.alias("source"), "doc_id", "score", "rank")


_SPACE_TOKENS = r"string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), ' ')"


@query("bm25_okapi", f"""
WITH d AS (SELECT doc_id, {_SPACE_TOKENS} AS toks FROM documents),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_SPACE_TOKENS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY doc_id, term),
s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d),
f AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, s GROUP BY term),
m AS (SELECT avg(idf) AS mean_idf FROM f),
r AS (SELECT item_id, doc_id, round(sum(qtf * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM p JOIN f USING (term) JOIN q USING (term), s, m GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 5""")
def bm25_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every question by Okapi statistics over the corpus and blank-cut words."""
    docs, questions = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    return bm.bm25_best(docs, questions, "doc_id", "item_id", 5, okapi=True, tokenise=bm.blank_words)


@query("evidence_rows", _BM25_SQL + """
, t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score, d.source, d.lang, d.source = 'src' || (item_id % 20) AS is_current,
  try_cast(substr(d.source, 4) AS INTEGER) < item_id % 20 AS is_history
FROM t JOIN documents d USING (doc_id) WHERE rank <= 10""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked evidence with where it comes from and to which scope it belongs."""
    best = _best(spark, sf_dir, 10)
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    own = F.col("item_id") % 20
    return best.join(docs, "doc_id").select(
        "item_id", "rank", "doc_id", "score", "source", "lang",
        (F.col("source") == F.concat(F.lit("src"), own)).alias("is_current"),
        (F.substring("source", 4, 9).try_cast("int") < own).alias("is_history"),
    )


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = f"({_DOT} / (sqrt({_DOT.replace('{b}', '{a}')}) * sqrt({_DOT.replace('{a}', '{b}')})))"
_PAIRS_SQL = f"""
WITH c AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, v.embedding, round({_COS.format(a='q.embedding', b='v.embedding')}, 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
"""


def _searched(spark: SparkSession, sf_dir: str, *picks: Pick) -> DataFrame:
    """Searches by the stated query set, the vectors whose id is divisible by 50."""
    vectors = load(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    own = vectors.filter(F.col("vec_id") % 50 == 0)
    queries = own.select(F.col("vec_id").alias("query"), (F.col("vec_id") % 10).alias("label"), F.col("embedding").alias("vector"))
    return find_vectors(rows, queries, picks)


@query("cosine_topk", _PAIRS_SQL + """
SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, Pick("best", 10)).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


_SHORT = _PAIRS_SQL + """
, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM c) WHERE n <= 200),
p1 AS (SELECT * FROM s WHERE n = 1),
v2 AS (SELECT s.*, round(0.7 * s.score - 0.3 * """ + _DOT.format(a="s.embedding", b="p1.embedding") + """, 6) AS value FROM s JOIN p1 USING (query_id)
  WHERE s.n <> p1.n AND NOT (s.label = p1.label AND abs(s.vec_id - p1.vec_id) < 5)),
p2 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, n) AS k FROM v2) WHERE k = 1),
v3 AS (SELECT s.*, round(0.7 * s.score - 0.3 * greatest(""" + _DOT.format(a="s.embedding", b="p1.embedding") + ", " + _DOT.format(a="s.embedding", b="p2.embedding") + """), 6) AS value
  FROM s JOIN p1 USING (query_id) JOIN p2 USING (query_id)
  WHERE s.n NOT IN (p1.n, p2.n) AND NOT (s.label = p1.label AND abs(s.vec_id - p1.vec_id) < 5) AND NOT (s.label = p2.label AND abs(s.vec_id - p2.vec_id) < 5)),
p3 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, n) AS k FROM v3) WHERE k = 1)
"""


@query("mmr_select", _SHORT + """
SELECT query_id, 1 AS pick, vec_id, score FROM p1 UNION ALL SELECT query_id, 2, vec_id, score FROM p2 UNION ALL SELECT query_id, 3, vec_id, score FROM p3""")
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three diverse frames for every query vector; the vector id stands for its second."""
    best = _searched(spark, sf_dir, Pick("best", 200)).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "label", "score")
    scored = best.join(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").withColumn("at", F.col("vec_id"))
    return mmr_select(scored, "query_id", "vec_id", "score", "label", "at", "embedding", k=3)


@query("pairwise_cosine", f"""
SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 100 = b.vec_id // 100""")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs inside a window, a label's vectors of a hundred ids, each with itself too."""
    vectors = load(spark, sf_dir, "embeddings").withColumn("window", F.floor(F.col("vec_id") / 100))
    a = vectors.select(F.col("vec_id").alias("a_id"), "label", "window", F.col("embedding").alias("va"))
    b = vectors.select(F.col("vec_id").alias("b_id"), "label", "window", F.col("embedding").alias("vb"))
    return a.join(b, ["label", "window"]).select("a_id", "b_id", "label", F.round(vec.cosine("va", "vb"), 6).alias("similarity"))


_ANCHOR_SQL = f"""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, list(mean ORDER BY i) AS anchor FROM (SELECT label, i, avg(x) AS mean FROM e GROUP BY label, i) GROUP BY label),
c AS (SELECT m.label AS anchor_label, v.vec_id, v.label, round({_COS.format(a='m.anchor', b='v.embedding')}, 6) AS score FROM m JOIN embeddings v ON m.label <> v.label)
"""


@query("anchor_similarity", _ANCHOR_SQL + """
SELECT anchor_label, vec_id, label, score, rank::INTEGER AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY anchor_label ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 2""")
def anchor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the mean vector of each label the two most similar vectors of other labels."""
    vectors = load(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    anchors = means.groupBy(F.col("label").alias("anchor_label")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("anchor")
    )
    rows = vectors.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    queries = anchors.select(F.col("anchor_label").alias("query"), F.col("anchor_label").alias("label"), F.col("anchor").alias("vector"))
    found = find_vectors(rows, queries, [Pick("best", 2, skip=("label",))])
    return found.select(F.col("query").alias("anchor_label"), F.col("id").alias("vec_id"), F.col("label").cast("int").alias("label"), "score", "rank")


@query("strawman_select", _PAIRS_SQL + """
SELECT query_id, 'most_similar' AS strategy, arg_max(vec_id, (score, -vec_id)) AS vec_id FROM c GROUP BY query_id
UNION ALL SELECT query_id, 'least_similar', arg_min(vec_id, (score, vec_id)) FROM c GROUP BY query_id
UNION ALL SELECT query_id, 'other_label', arg_max(vec_id, (score, -vec_id)) FROM c WHERE label <> (query_id % 10) GROUP BY query_id
UNION ALL SELECT query_id, 'picked_by_hash', arg_min(vec_id, ((('0x' || substr(md5(vec_id::VARCHAR), 1, 13))::BIGINT - ('0x' || substr(md5('q' || query_id), 1, 13))::BIGINT + 4503599627370496) % 4503599627370496, vec_id)) FROM c GROUP BY query_id
UNION ALL SELECT DISTINCT query_id, 'self', query_id FROM c""")
def strawman_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What simple strategies would pick for every query; the random one is the next on a ring of hashes."""
    picks = [
        Pick("most_similar", 1), Pick("least_similar", 1, by="least"), Pick("other_label", 1, skip=("id", "label")), Pick("picked_by_hash", 1, by="ring"),
        Pick("self", 1, skip=()),
    ]
    found = _searched(spark, sf_dir, *picks)
    own = F.when(F.col("pick") == "self", F.col("query")).otherwise(F.col("id"))
    return found.select(F.col("query").alias("query_id"), F.col("pick").alias("strategy"), own.alias("vec_id"))


@query("gaussian_score", """
SELECT event_id, round(exp(-(pow(value - 250, 2) + pow(user_id * 2 - 150, 2)) / (2 * pow(80, 2))), 6) AS score FROM events""")
def gaussian_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near a gaze point lies to the centre of a box."""
    score = vec.gaussian_box_score(F.col("value"), F.col("user_id") * 2, (200.0, 100.0, 300.0, 200.0), 80.0)
    return load(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@query("affine_project", """
WITH g AS (SELECT event_id, (value - 250) / 1000 AS yaw, (user_id - 75) / 500.0 AS pitch, 1 + value / 500 AS depth FROM events),
p AS (SELECT event_id, tan(yaw) * depth AS x, tan(pitch) * depth AS y, depth AS z FROM g),
c AS (SELECT event_id, 0.0 * x - 1.0 * y + 0.0 * z + 0.1 AS x, 1.0 * x + 0.0 * y + 0.0 * z - 0.2 AS y, 0.0 * x + 0.0 * y + 1.0 * z + 0.05 AS z FROM p),
u AS (SELECT event_id, CASE WHEN z > 0 THEN 600 * x / z + 320 END AS px, CASE WHEN z > 0 THEN 600 * y / z + 240 END AS py FROM c)
SELECT event_id, round(px, 4) AS px, round(py, 4) AS py, px >= 0 AND px < 640 AND py >= 0 AND py < 480 AS in_frame FROM u""")
def affine_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaze angles to a point in space, moved by a camera pose and projected to a pixel."""
    e = load(spark, sf_dir, "events")
    point = vec.gaze_point((F.col("value") - 250) / 1000, (F.col("user_id") - 75) / F.lit(500.0), 1 + F.col("value") / 500)
    pose = [[0.0, -1.0, 0.0, 0.1], [1.0, 0.0, 0.0, -0.2], [0.0, 0.0, 1.0, 0.05]]
    px, py = vec.pinhole(vec.affine(pose, point), 600.0, 600.0, 320.0, 240.0)
    return e.select("event_id", px.alias("x"), py.alias("y")).select(
        "event_id", F.round("x", 4).alias("px"), F.round("y", 4).alias("py"),
        ((F.col("x") >= 0) & (F.col("x") < 640) & (F.col("y") >= 0) & (F.col("y") < 480)).alias("in_frame"),
    )


_STOP_SQL = "['" + "', '".join(STOPWORDS) + "']"
_STEM_SQL = "CASE WHEN len(t) > 5 AND t LIKE '%ing' THEN t[:-4] WHEN len(t) > 5 AND t LIKE '%ed' THEN t[:-3] WHEN len(t) > 5 AND t LIKE '%es' THEN t[:-3] WHEN len(t) > 5 AND t LIKE '%s' THEN t[:-2] ELSE t END"
_LONG_SQL = "list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9'']+', 0), lambda t: trim(t, '''')), lambda t: len(t) >= 2)"
_CONTENT_SQL = f"""list_filter(list_distinct(list_transform(list_filter({_LONG_SQL}, lambda t: NOT list_contains({_STOP_SQL}, t)), lambda t: {_STEM_SQL})), lambda t: NOT list_contains({_STOP_SQL}, t))"""


@query("token_overlap", _BM25_SQL + f"""
, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10),
b AS (SELECT item_id, {_CONTENT_SQL} AS need FROM benchmark), h AS (SELECT doc_id, {_CONTENT_SQL} AS have FROM documents)
SELECT item_id, doc_id, len(need)::BIGINT AS n_need, len(have)::BIGINT AS n_have, len(list_intersect(need, have))::BIGINT AS shared,
  round(len(list_intersect(need, have)) / greatest(1, len(need)), 6) AS coverage FROM t JOIN b USING (item_id) JOIN h USING (doc_id)""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared content tokens of every question and each of its ten best documents."""
    need = load(spark, sf_dir, "benchmark").select("item_id", tx.content_tokens("text", STOPWORDS).alias("need"))
    best = _best(spark, sf_dir, 10).select("item_id", "doc_id")
    evidence = load(spark, sf_dir, "documents").join(best, "doc_id").select("item_id", "doc_id", tx.content_tokens("text", STOPWORDS).alias("have"))
    shared = tx.overlap(F.col("need"), F.col("have")).cast("long")
    return evidence.join(need, "item_id").select(
        "item_id", "doc_id", F.size("need").cast("long").alias("n_need"), F.size("have").cast("long").alias("n_have"), shared.alias("shared"),
        F.round(tx.coverage(F.col("need"), F.col("have")), 6).alias("coverage"),
    )


@query("retrieval_tokens", f"""
WITH t AS (SELECT doc_id, list_transform(list_filter({_LONG_SQL}, lambda t: NOT list_contains({_STOP_SQL}, t)), lambda t: {_STEM_SQL}) AS w FROM documents)
SELECT doc_id, len(w)::INTEGER AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM t""")
def retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed words in order without stopwords, as a digest."""
    words = load(spark, sf_dir, "documents").select("doc_id", tx.retrieval_tokens("text", STOPWORDS).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("complementarity", f"""
WITH c AS (SELECT conv_id, turn, {_CONTENT_SQL} AS toks FROM conversations)
SELECT a.conv_id, a.turn AS a_turn, b.turn AS b_turn, len(list_intersect(a.toks, b.toks)) AS shared,
  len(a.toks) - len(list_intersect(a.toks, b.toks)) AS only_a, len(b.toks) - len(list_intersect(a.toks, b.toks)) AS only_b,
  2 * len(list_intersect(a.toks, b.toks)) + least(len(a.toks) - len(list_intersect(a.toks, b.toks)), len(b.toks) - len(list_intersect(a.toks, b.toks)), 10) AS score
FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How neighbouring turns agree and what each adds: twice the shared tokens plus the lesser addition."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.content_tokens("text", STOPWORDS).alias("toks"))
    a = turns.select("conv_id", F.col("turn").alias("a_turn"), F.col("toks").alias("ta"))
    b = turns.select("conv_id", F.col("turn").alias("b_turn"), (F.col("turn") - 1).alias("a_turn"), F.col("toks").alias("tb"))
    shared = tx.overlap(F.col("ta"), F.col("tb")).cast("long")
    only_a, only_b = F.size("ta").cast("long") - shared, F.size("tb").cast("long") - shared
    return a.join(b, ["conv_id", "a_turn"]).select(
        "conv_id", "a_turn", "b_turn", shared.alias("shared"), only_a.alias("only_a"), only_b.alias("only_b"),
        (2 * shared + F.least(only_a, only_b, F.lit(10))).alias("score"),
    )


@query("tokenize_ws", r"""
SELECT doc_id, len(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), ' '))::BIGINT AS n_tokens,
  len(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), ' '), lambda t: t = ''))::BIGINT AS n_empty
FROM documents""")
def tokenize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space tokens of every document, empty ones counted."""
    tokens = tx.space_tokens("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.filter(tokens, lambda t: t == "")).cast("long").alias("n_empty"))


@query("snippet", """
SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN substr(text, greatest(instr(text, 'the') - 20, 1),
  instr(text, 'the') - greatest(instr(text, 'the') - 20, 1) + 20 + 3) END AS snippet FROM documents""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.snippet("text", "the", 20).alias("snippet"))


def fuzzy_ratio(pairs: DataFrame, needle: str, text: str) -> DataFrame:
    """Add ``fuzzy_score``: 3 for a term found as a substring, 1 for one with a word of similar
    spelling (matching-blocks ratio of term and word of at least 0.84), summed over the terms of ``needle``.

    The ratio has no SQL form, so rows pass through Python in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from difflib import SequenceMatcher

        matcher = SequenceMatcher(None)
        for batch in batches:
            scores = []
            for terms, body in zip(batch.column(needle).to_pylist(), batch.column(text).to_pylist()):
                lower, score = (body or "").lower(), 0
                words = sorted(set(re.findall("[a-z0-9]+", lower)))
                for term in dict.fromkeys((terms or "").lower().split()):
                    if term in lower:
                        score += 3
                        continue
                    matcher.set_seq1(term)
                    for word in words:
                        matcher.set_seq2(word)
                        if matcher.real_quick_ratio() >= 0.84 and matcher.quick_ratio() >= 0.84 and matcher.ratio() >= 0.84:
                            score += 1
                            break
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.int64())], [*batch.schema.names, "fuzzy_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{fields}, fuzzy_score long")


@query("fuzzy_score")
def fuzzy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy hits of each turn's first three words in the turn before."""
    turns = load(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select("conv_id", "turn", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("terms"), before.alias("body"))
    return fuzzy_ratio(pairs, "terms", "body").select("conv_id", "turn", "fuzzy_score")

"""Classification queries: decision lists, flags, gates and row validation.

Dictionaries and thresholds are parameters; the test tables' prose holds only words like those below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.decisions import best_option, decision_list, reasons, true_labels
from ..sources.tables import load
from .registry import query
from ..operators import evidence as ev
from ..operators.retrieval import bm25_best
from .retrieval import _CONTENT_SQL, _TOKENS, STOPWORDS

_WORD = "regexp_matches(lower(text), '(^|[^a-z0-9_]){0}($|[^a-z0-9_])')"


@query("keyword_flags", f"""
WITH f AS (SELECT doc_id, {_WORD.format('with')} AS w1, {_WORD.format('from')} AS w2, contains(lower(text), 'of the') AS w3 FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN w1 THEN 'company' END, CASE WHEN w2 THEN 'origin' END, CASE WHEN w3 THEN 'possession' END], lambda x: x IS NOT NULL), ';') AS labels,
  CASE WHEN w3 THEN 'possession' WHEN w2 THEN 'origin' WHEN w1 THEN 'company' ELSE 'other' END AS main FROM f""")
def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by keywords, whole words or phrases, and the first label in order of priority."""
    flags = {"company": tx.has_any("text", ["with"]), "origin": tx.has_any("text", ["from"]), "possession": tx.has_any("text", ["of the"])}
    main = decision_list([(flags[k], k) for k in ("possession", "origin", "company")], "other")
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(true_labels(flags), ";").alias("labels"), main.alias("main"))


@query("regex_flags", r"""
SELECT doc_id, regexp_matches(text, '[0-9]{3,}') AS has_number, regexp_matches(text, '[A-Z]{5,}') AS shouts, regexp_matches(text, '[a-z]+@[a-z]+') AS has_address,
  regexp_matches(text, '^[A-Z]') AS starts_upper FROM documents""")
def regex_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = {"has_number": "[0-9]{3,}", "shouts": "[A-Z]{5,}", "has_address": "[a-z]+@[a-z]+", "starts_upper": "^[A-Z]"}
    return load(spark, sf_dir, "documents").select("doc_id", *[F.col("text").rlike(p).alias(name) for name, p in patterns.items()])


@query("entity_mentions", """
WITH n AS (SELECT unnest(['the', 'der', 'les', 'que', 'und']) AS name, unnest(['EN', 'DE', 'FR', 'ES', 'DE']) AS entity),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS tok FROM documents)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT entity)), ';') AS entities, count(*) AS names FROM t JOIN n ON tok = name GROUP BY doc_id""")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a dictionary that occur as words, as their canonical entities."""
    names = [("the", "EN"), ("der", "DE"), ("les", "FR"), ("que", "ES"), ("und", "DE")]
    dictionary = spark.createDataFrame(names, "tok string, entity string")
    tokens = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.alnum_tokens("text"))).alias("tok"))
    found = tokens.join(F.broadcast(dictionary), "tok")
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), ";").alias("entities"), F.count("*").alias("names"))


# Questions, answers and scopes: an item's text asks, its fourth and fifth word are the answer, or for every fifth item a list of
# options; documents of source ``item_id % 20`` are current, those of lower sources history, both together plus.
_BROAD, _EVERY = r"\bthat\b", r"\bwith\b.*\bthe\b"
_ASSESS_SQL = f"""
WITH d AS (SELECT doc_id, try_cast(substr(source, 4) AS INTEGER) AS src, {_TOKENS} AS toks FROM documents),
a AS (SELECT item_id, text, CASE WHEN item_id % 5 = 0 THEN 'A-C' ELSE coalesce(split_part(text, ' ', 4), '') || ' ' || coalesce(split_part(text, ' ', 5), '') END AS answer,
  'A) ' || split_part(text, ' ', 2) || ', B) none, C) ' || split_part(text, ' ', 3) || '.' AS options, item_id % 20 AS own FROM benchmark),
m AS (SELECT DISTINCT own, scope, src FROM (SELECT DISTINCT own FROM a), (SELECT DISTINCT src FROM d), (SELECT unnest(['current', 'history', 'plus']) AS scope)
  WHERE (scope = 'current' AND src = own) OR (scope = 'history' AND src < own) OR (scope = 'plus' AND src <= own)),
q AS (SELECT item_id, own, term, least(count(*), 3) AS qtf FROM (SELECT item_id, own, unnest({_TOKENS}) AS term FROM a) GROUP BY ALL),
p AS (SELECT doc_id, src, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, src, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY doc_id, src, term),
s AS (SELECT own, scope, count(*) AS n, avg(len(toks)) AS mean FROM d JOIN m USING (src) GROUP BY own, scope),
f AS (SELECT own, scope, term, count(*) AS df FROM p JOIN m USING (src) WHERE term IN (SELECT term FROM q) GROUP BY own, scope, term),
r AS (SELECT item_id, scope, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM q JOIN m USING (own) JOIN p USING (src, term) JOIN f USING (own, scope, term) JOIN s USING (own, scope) GROUP BY item_id, scope, doc_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, scope ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10),
h AS (SELECT doc_id, {_CONTENT_SQL} AS have, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM documents WHERE doc_id IN (SELECT doc_id FROM b)),
g AS (SELECT item_id, scope, count(*) AS n_ranked, list_distinct(flatten(list(have))) AS have, string_agg(body, ' ' ORDER BY rank) AS body FROM b JOIN h USING (doc_id) GROUP BY item_id, scope),
n AS (SELECT item_id, answer, CASE WHEN answer = 'A-C' THEN split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) ELSE answer END AS expanded, text || ' ' || options AS question FROM a),
k AS (SELECT item_id, question, lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS plain, {_CONTENT_SQL.replace('lower(text)', 'lower(expanded)')} AS need,
  {_CONTENT_SQL.replace('lower(text)', 'lower(question)')} AS asks FROM n),
v AS (SELECT item_id, scope, coalesce(n_ranked, 0) AS n_ranked, list_sort(list_intersect(need, coalesce(have, []))) AS hits, len(list_intersect(asks, coalesce(have, []))) AS overlap,
    len(plain) > 2 AND NOT regexp_full_match(plain, '[0-9]+([.][0-9]+)?') AND contains(coalesce(body, ''), plain) AS direct, len(need) AS n_need, trim(coalesce(body, '')) = '' AS bare,
    regexp_matches(lower(question), '{_BROAD}') AS broad, regexp_matches(lower(question), '{_EVERY}') AS every
  FROM k CROSS JOIN (SELECT unnest(['current', 'history', 'plus']) AS scope) LEFT JOIN g USING (item_id, scope)),
w AS (SELECT *, len(hits) / greatest(1, n_need) AS c FROM v),
x AS (SELECT *, CASE WHEN bare THEN 'not' WHEN broad AND NOT every AND c >= 0.85 AND overlap >= 6 AND n_ranked >= 6 THEN 'likely' WHEN broad AND c >= 0.55 AND overlap >= 3 THEN 'partial'
    WHEN broad AND (overlap >= 4 OR c >= 0.25) THEN 'unclear' WHEN broad THEN 'not' WHEN direct AND overlap >= 2 THEN 'likely' WHEN c >= 0.7 AND overlap >= 2 THEN 'likely'
    WHEN c >= 0.5 AND overlap >= 5 THEN 'likely' WHEN c >= 0.35 AND overlap >= 2 THEN 'partial' WHEN c > 0 OR overlap >= 4 THEN 'unclear' ELSE 'not' END AS label FROM w)
"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question in every scope with its ten best documents of the scope assessed."""
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    answer = F.when(F.col("item_id") % 5 == 0, "A-C").otherwise(F.concat(word(4), F.lit(" "), word(5)))
    options = F.concat(F.lit("A) "), word(2), F.lit(", B) none, C) "), word(3), F.lit("."))
    items = load(spark, sf_dir, "benchmark").select("item_id", "text", F.concat("text", F.lit(" "), options).alias("question"), answer.alias("answer"))
    names = lambda first, last: F.transform(F.sequence(first, last), lambda i: F.concat(F.lit("src"), i))
    own = F.col("item_id") % 20
    none = F.array().cast("array<string>")
    pools = {"current": names(own, own), "history": F.when(own > 0, names(F.lit(0).cast("long"), own - 1)).otherwise(none), "plus": names(F.lit(0).cast("long"), own)}
    scoped = F.explode(F.array(*[F.struct(F.lit(k).alias("scope"), v.alias("pool")) for k, v in pools.items()])).alias("s")
    asked = items.select("*", scoped).select("*", "s.*", F.concat_ws("|", F.col("item_id").cast("string"), "s.scope").alias("ask")).drop("s")
    docs = load(spark, sf_dir, "documents")
    ranked = bm25_best(docs, asked, "doc_id", "ask", 10, source="source", pool="pool")
    sets = ev.evidence_sets(ranked, docs, "ask", "doc_id", "text", STOPWORDS)
    return ev.assess(asked, sets, "ask", F.col("question"), F.col("answer"), STOPWORDS, _BROAD, _EVERY)


@query("answerability_label", _ASSESS_SQL + """
SELECT item_id, scope, label, n_ranked::BIGINT AS n_ranked, round(c, 6) AS coverage, overlap::INTEGER AS overlap, array_to_string(hits, ';') AS hits, direct FROM x""")
def answerability_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the ten best documents of each scope answer a question."""
    return _assessed(spark, sf_dir).select(
        "item_id", "scope", "label", F.col("n_ranked").cast("long").alias("n_ranked"), F.round("coverage", 6).alias("coverage"), "overlap", F.array_join("hits", ";").alias("hits"), "direct"
    )


_RANK_SQL = "CASE {0} WHEN 'likely' THEN 3 WHEN 'partial' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END"


@query("gain_label", _ASSESS_SQL + f"""
, o AS (SELECT item_id, any_value(x) FILTER (WHERE scope = 'current') AS now, any_value(x) FILTER (WHERE scope = 'history') AS past, any_value(x) FILTER (WHERE scope = 'plus') AS plus FROM x GROUP BY item_id),
e AS (SELECT *, {_RANK_SQL.format('now.label')} AS r_now, {_RANK_SQL.format('past.label')} AS r_past, {_RANK_SQL.format('plus.label')} AS r_plus,
  past.label IN ('likely', 'partial') OR (past.label = 'unclear' AND (past.c >= 0.2 OR past.overlap >= 4)) AS relevant,
  len(list_filter(plus.hits, lambda t: NOT list_contains(now.hits, t))) > 0 OR plus.overlap >= now.overlap + 2 AS added FROM o)
SELECT item_id, CASE WHEN r_plus > r_now AND r_plus >= 2 AND relevant THEN 'yes' WHEN r_plus > r_now AND relevant THEN 'promising' WHEN r_now = 3 AND r_plus <= r_now THEN 'no'
  WHEN r_plus >= r_now AND r_plus > 0 AND relevant AND added THEN 'promising' WHEN r_plus = r_now THEN 'no' ELSE 'unclear' END AS gain,
  CASE WHEN r_plus >= r_now AND r_plus >= r_past THEN 'plus' WHEN r_now >= r_past THEN 'current' ELSE 'history' END AS best_scope FROM e""")
def gain_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether history adds to what the current scope answers, and the best scope."""
    fields = F.struct("label", "coverage", "overlap", "hits")
    of = lambda scope: F.max(F.when(F.col("scope") == scope, fields)).alias(scope)
    scopes = _assessed(spark, sf_dir).groupBy("item_id").agg(of("current"), of("history"), of("plus"))
    now, past, plus = F.col("current"), F.col("history"), F.col("plus")
    return scopes.select("item_id", ev.gain_label(now, past, plus).alias("gain"), ev.best_scope(now, past, plus).alias("best_scope"))


@query("rubric_tier", """
SELECT doc_id, CASE WHEN lang <> 'en' THEN 'E' WHEN n_chars >= 4000 AND toxic = 0 THEN 'A' WHEN n_chars >= 1500 AND quality = 1 THEN 'B' WHEN quality = 1 THEN 'C' ELSE 'D' END AS tier,
  quality = 1 AND toxic = 0 AS keep, CASE WHEN quality = 1 AND n_chars > 1000 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'low' END AS confidence
FROM documents JOIN labels USING (doc_id)""")
def rubric_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    good, clean, n = F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars")
    tier = decision_list([(F.col("lang") != "en", "E"), ((n >= 4000) & clean, "A"), ((n >= 1500) & good, "B"), (good, "C")], "D")
    confidence = decision_list([(good & (n > 1000), "high"), (good, "medium")], "low")
    return rows.select("doc_id", tier.alias("tier"), (good & clean).alias("keep"), confidence.alias("confidence"))


@query("fallback_inference", """
WITH c AS (SELECT conv_id, count(DISTINCT role) FILTER (WHERE role <> 'system') AS n, min(role) FILTER (WHERE role <> 'system') AS only_role, max(text) FILTER (WHERE turn = 0) AS opening, max(role) FILTER (WHERE turn = 0) AS opener FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN contains(opening, ' is ') THEN 'explicit' WHEN n = 1 THEN only_role WHEN opener <> 'system' THEN opener ELSE 'UNKNOWN' END AS speaker,
  CASE WHEN contains(opening, ' is ') THEN 'pattern' WHEN n = 1 THEN 'single speaker' WHEN opener <> 'system' THEN 'opener' ELSE 'none' END AS how FROM c""")
def fallback_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asks: by a pattern, else the only speaker, else who opens, else unknown."""
    people = F.when(F.col("role") != "system", F.col("role"))
    first = lambda c: F.max(F.when(F.col("turn") == 0, F.col(c)))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.countDistinct(people).alias("n"), F.min(people).alias("only_role"), first("text").alias("opening"), first("role").alias("opener")
    )
    explicit, single, opened = F.coalesce(F.col("opening").contains(" is "), F.lit(False)), F.col("n") == 1, F.coalesce(F.col("opener") != "system", F.lit(False))
    speaker = F.when(explicit, "explicit").when(single, F.col("only_role")).when(opened, F.col("opener")).otherwise("UNKNOWN")
    how = decision_list([(explicit, "pattern"), (single, "single speaker"), (opened, "opener")], "none")
    return c.select("conv_id", speaker.alias("speaker"), how.alias("how"))


@query("argmax_label", """
WITH c AS (SELECT user_id, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'view')::BIGINT AS seen, count_if(event_type = 'error')::BIGINT AS failed FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN click >= seen AND click >= failed THEN 'click' WHEN seen >= failed THEN 'seen' ELSE 'failed' END AS likely FROM c""")
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(n("click").alias("click"), n("view").alias("seen"), n("error").alias("failed"))
    return counts.select("user_id", best_option({c: F.col(c) for c in ("click", "seen", "failed")}).alias("likely"))


_PATH_RULES_SQL = """CASE WHEN regexp_matches(url, '\\?.*utm_') THEN 'campaign' WHEN regexp_matches(url, '[.]html?($|[?#])') THEN 'page' WHEN regexp_matches(url, '[?]') THEN 'listing'
  WHEN regexp_matches(url, '/$') THEN 'folder' ELSE 'plain' END"""


def path_kind(url):
    """Ordered rules on a path; the first that holds."""
    rules = [(r"\?.*utm_", "campaign"), (r"[.]html?($|[?#])", "page"), (r"[?]", "listing"), (r"/$", "folder")]
    return decision_list([(url.rlike(pattern), label) for pattern, label in rules], "plain")


@query("path_classify", f"SELECT page_id, {_PATH_RULES_SQL} AS kind, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", path_kind(url).alias("kind"), F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"))


@query("route_decision", f"""
WITH k AS (SELECT page_id, {_PATH_RULES_SQL} AS kind, len(html) AS size FROM pages),
i AS (SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM k GROUP BY kind)
SELECT page_id, k.kind, CASE WHEN n < 5 THEN 'manual' WHEN k.kind = 'campaign' THEN 'skip' WHEN size > 20000 THEN 'stream' ELSE 'fetch' END AS route,
  concat_ws('; ', CASE WHEN n < 5 THEN 'rare kind' END, CASE WHEN size > 20000 THEN 'large' END) AS why FROM k JOIN i USING (kind)""")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision table over a page and the inventory of its kind."""
    pages = load(spark, sf_dir, "pages").select("page_id", path_kind(F.col("url")).alias("kind"), F.char_length("html").alias("size"))
    inventory = pages.groupBy("kind").agg(F.count("*").alias("n"))
    rare, large = F.col("n") < 5, F.col("size") > 20_000
    route = decision_list([(rare, "manual"), (F.col("kind") == "campaign", "skip"), (large, "stream")], "fetch")
    return pages.join(inventory, "kind").select("page_id", "kind", route.alias("route"), reasons([(rare, "rare kind"), (large, "large")], "; ").alias("why"))


@query("validate_rows", """
WITH v AS (SELECT doc_id, list_filter([CASE WHEN n_chars <> len(text) THEN 'n_chars differs' END, CASE WHEN n_chars < 100 THEN 'too short' END,
  CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unexpected lang' END, CASE WHEN NOT regexp_matches(source, '^src1?[0-9]$') THEN 'bad source' END], lambda x: x IS NOT NULL) AS errors FROM documents)
SELECT doc_id, i::INTEGER AS n, errors[i] AS error FROM (SELECT doc_id, errors, unnest(range(1, len(errors) + 1)) AS i FROM v)""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every row, numbered."""
    rules = [
        (F.col("n_chars") != F.char_length("text"), "n_chars differs"), (F.col("n_chars") < 100, "too short"),
        (~F.col("lang").isin("en", "de", "fr"), "unexpected lang"), (~F.col("source").rlike("^src1?[0-9]$"), "bad source"),
    ]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(errors).alias("n", "error")).withColumn("n", F.col("n") + 1)


@query("reason_strings", """
SELECT event_id, concat_ws(' | ', CASE WHEN value > 300 THEN 'high value' END, CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN user_id < 20 THEN 'early user ' || user_id END) AS why FROM events""")
def reason_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = reasons([
        (F.col("value") > 300, "high value"), (F.col("event_type") == "error", "failed"),
        (F.col("user_id") < 20, F.concat(F.lit("early user "), F.col("user_id").cast("string"))),
    ])
    return load(spark, sf_dir, "events").select("event_id", why.alias("why"))


@query("coalesce_reason", """
SELECT doc_id, coalesce(CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, 'plain') AS value,
  CASE WHEN n_chars > 3000 THEN 'from length' WHEN lang <> 'en' THEN 'from language' ELSE 'default' END AS reason FROM documents""")
def coalesce_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that a rule gives, and which rule gave it."""
    long, foreign = F.col("n_chars") > 3000, F.col("lang") != "en"
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.when(long, "long"), F.when(foreign, "foreign"), F.lit("plain")).alias("value"),
        decision_list([(long, "from length"), (foreign, "from language")], "default").alias("reason"),
    )


@query("scope_filter_join", """
WITH m AS (SELECT unnest(['current', 'current', 'history', 'plus', 'plus', 'plus']) AS scope, unnest(['click', 'view', 'signup', 'click', 'signup', 'error']) AS event_type),
r AS (SELECT scope, user_id, event_id, row_number() OVER (PARTITION BY scope, user_id ORDER BY e.event_type, value DESC, event_id) AS n FROM events e JOIN m USING (event_type))
SELECT scope, user_id, event_id, n::INTEGER AS n FROM r WHERE n <= 3""")
def scope_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose mode a scope allows, by a small table of (scope, mode), ordered by mode and score."""
    allowed = [("current", "click"), ("current", "view"), ("history", "signup"), ("plus", "click"), ("plus", "signup"), ("plus", "error")]
    modes = spark.createDataFrame(allowed, "scope string, event_type string")
    joined = load(spark, sf_dir, "events").join(F.broadcast(modes), "event_type")
    n = F.row_number().over(Window.partitionBy("scope", "user_id").orderBy("event_type", F.desc("value"), "event_id"))
    return joined.withColumn("n", n).filter("n <= 3").select("scope", "user_id", "event_id", "n")

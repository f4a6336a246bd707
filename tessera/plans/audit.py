"""Audit, matching and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import panels as N
from tessera.operators.lexicon import alias_lookup
from tessera.operators.texts import host_of, letters
from tessera.plans.binding import LOG_SQL, Plans, task_log
from tessera.plans.charts import YEARS, part_rows, statements
from tessera.plans.text import HOST, WORDS

P = Plans()


def figures(r):
    """Order totals are the reported figures, line prices their sources."""
    return r("orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderkey").alias("figure_id"), F.col("o_totalprice").alias("figure"))


def lines(r):
    return r("lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_extendedprice").alias("value"))


def traced(r):
    total = lines(r).groupBy("task").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return A.trace_status(A.number_trace(figures(r), lines(r), "task"), total, "task")


TRACE = "WITH f AS (SELECT o_orderkey AS task, o_totalprice AS figure FROM orders), h AS (SELECT task, arg_min(l_extendedprice, (abs(l_extendedprice - figure), l_extendedprice)) AS nearest FROM f JOIN lineitem ON l_orderkey = task GROUP BY task), n AS (SELECT task, figure, nearest, coalesce(abs(nearest - figure) < greatest(0.5::DOUBLE, abs(figure) * 0.005::DOUBLE), false) AS traced FROM f LEFT JOIN h USING (task))"
STATUS = f"""{TRACE}, t AS (SELECT l_orderkey AS task, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1),
s AS (SELECT task, task AS figure_id, CASE WHEN traced THEN 'structured' WHEN abs(total - figure) <= 0.02::DOUBLE * abs(figure) THEN 'derived' ELSE 'untraceable' END AS status FROM n LEFT JOIN t USING (task))"""
P.add("number_trace", lambda r: A.number_trace(figures(r), lines(r), "task"), f"{TRACE} SELECT task, task AS figure_id, figure, nearest, traced FROM n")
P.add("trace_rates", lambda r: traced(r).join(r("orders").select(F.col("o_orderkey").alias("task"), "o_orderpriority"), "task").groupBy("o_orderpriority").agg(F.count("*").alias("figures"), F.round(F.avg((F.col("status") == "structured").cast("int")), 6).alias("structured"), F.round(F.avg((F.col("status") == "derived").cast("int")), 6).alias("derived")), f"{STATUS} SELECT o_orderpriority, count(*) AS figures, round(avg(CASE WHEN status = 'structured' THEN 1 ELSE 0 END), 6) AS structured, round(avg(CASE WHEN status = 'derived' THEN 1 ELSE 0 END), 6) AS derived FROM s JOIN orders ON o_orderkey = task GROUP BY 1")


def growth_claims(r):
    claims = r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("claim_id"), F.col("n_name").alias("entity"), (F.col("c_acctbal") / 100).alias("percent"))
    revenue = statements(r).where("metric = 'revenue'").select("entity", "year", "value")
    return A.derived_growth(claims, N.yoy_growth(revenue, "entity", "value"), "entity")


P.add("derived_trace", growth_claims, f"""{YEARS}, g AS (SELECT entity, abs(round((revenue / nullif(lag(revenue) OVER (PARTITION BY entity ORDER BY year), 0) - 1) * 100, 4)) AS g FROM y)
SELECT c_custkey AS claim_id, n_name AS entity, EXISTS (SELECT 1 FROM g WHERE g.entity = n_name AND abs(g.g - abs(c_acctbal / 100)) < 0.05::DOUBLE) AS derived FROM customer JOIN nation ON c_nationkey = n_nationkey""")
P.add("conflicting_figures", lambda r: A.conflicting_figures(r("lineitem").select(F.col("l_partkey").alias("metric"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("value")), ["metric", "year"]), "WITH c AS (SELECT l_partkey AS metric, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL) SELECT metric, year, arg_max(value, (n, -value)) AS main_value, count(*) - 1 AS others FROM c GROUP BY metric, year HAVING count(*) > 1")
SENTENCES = r"""s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([0-9])\.', '\1' || chr(1), 'g'), '\.([0-9])', chr(1) || '\1', 'g'), '[.;\n。；．]'), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '')) AS sentence FROM documents)"""
P.add("entity_attribution", lambda r: A.entity_attribution(r("documents"), ["der", "die"], ["the", "and"]), rf"""WITH {SENTENCES}, w AS (SELECT doc_id, regexp_split_to_array(lower(sentence), '[^\p{{L}}]+') AS w, unnest(regexp_extract_all(sentence, '[0-9]+(?:\.[0-9]+)?')) AS number FROM s),
n AS (SELECT doc_id, number, bool_or(list_has_any(w, ['der', 'die'])) AS near_target, bool_or(list_has_any(w, ['the', 'and'])) AS near_other FROM w GROUP BY ALL) SELECT *, near_other AND NOT near_target AS flagged FROM n""")
#: The rest of the attribution rules, on documents that are their own sources; no SQL twin.
P.add("entity_attribution_evidence", lambda r: A.attribution_evidence(r("documents").select("doc_id", "text"), r("documents").select("doc_id", "text"), "doc_id", ["der", "die"], ["the", "and"], ["with", "mit"], ["in", "of", "und"]))
P.add("source_labeling", lambda r: A.source_labeling(r("documents").select(F.col("doc_id").alias("claim_id"), F.col("source")), r("documents").groupBy("source").agg(F.count("*").alias("n")).where("n >= 50")), "SELECT doc_id AS claim_id, source, coalesce(source IN (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 50), false) AS labelled FROM documents")


def part_facts(r):
    """Every part is told three times: in full, by a part of its name without a year, and by its whole name without region."""
    year = F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 20 + 2000)
    value = (F.floor(F.col("p_retailprice") / 50) * 50).cast("long")
    one = lambda label, y, region, source: F.struct(F.col("p_type").alias("type"), value.alias("value"), F.col("p_brand").alias("unit"), label.alias("label"), y.alias("year"), region.alias("region"), source.alias("source"))
    name, none = F.col("p_name"), F.lit(None).cast("string")
    told = [
        one(name, year, F.when(F.col("p_size") > 25, "east"), none),
        one(F.substring_index(name, " ", 1), F.lit(None).cast("int"), F.lit("west"), F.lit("press")),
        one(name, F.lit(None).cast("int"), none, F.lit("site")),
    ]
    return r("part").select(F.explode(F.array(*told)).alias("f")).select("f.*")


FACTS = """WITH p AS (
  SELECT p_type AS type, CAST(floor(p_retailprice / 50) * 50 AS BIGINT) AS value, p_brand AS unit, p_name, p_size, CASE WHEN p_size % 3 > 0 THEN p_size % 20 + 2000 END AS y FROM part
), f AS (
  SELECT type, value, unit, p_name AS label, y AS year, CASE WHEN p_size > 25 THEN 'east' END AS region, NULL AS source FROM p
  UNION ALL SELECT type, value, unit, split_part(p_name, ' ', 1), NULL, 'west', 'press' FROM p
  UNION ALL SELECT type, value, unit, p_name, NULL, NULL, 'site' FROM p
), c AS (
  SELECT type, value, unit, label, year, min(region) AS region, min(source) AS source, count(*) AS copies, row_number() OVER () AS id FROM f GROUP BY type, value, unit, label, year
), pairs AS (
  SELECT a.id AS a, b.id AS b, b.label, b.year FROM c a JOIN c b USING (type, value, unit)
  WHERE a.label <> '' AND ((length(b.label) > length(a.label) AND contains(b.label, a.label) AND coalesce(a.year = b.year, true)) OR (a.label = b.label AND a.year IS NULL AND b.year IS NOT NULL))
), merged AS (
  SELECT a, b FROM pairs WHERE b NOT IN (SELECT a FROM pairs) QUALIFY row_number() OVER (PARTITION BY a ORDER BY length(label) DESC, label, coalesce(year, 0)) = 1
), given AS (
  SELECT b AS id, min(year) AS y, min(region) AS r, min(source) AS s, sum(copies) AS n FROM merged JOIN c ON c.id = merged.a GROUP BY b
)"""
P.add("dedupe_facts", lambda r: A.absorb_labels(A.collapse_facts(part_facts(r))), f"""{FACTS}
SELECT type, value, unit, label, coalesce(year, y) AS year, coalesce(region, r) AS region, coalesce(source, s) AS source, CAST(copies + coalesce(n, 0) AS BIGINT) AS copies
FROM c LEFT JOIN given USING (id) WHERE id NOT IN (SELECT a FROM merged)""")
P.add("foreign_entity_filter", lambda r: A.foreign_entity_filter(part_facts(r), "red", ["ring", "widget"]), rf"{FACTS} SELECT * FROM f WHERE NOT list_has_any(regexp_split_to_array(lower(label), '[^\p{{L}}]+'), ['ring', 'widget']) OR contains(label, 'red')")
P.add("facts_union", lambda r: N.facts_union([part_facts(r), r("orders").select(F.lit("order").alias("type"), F.col("o_orderkey").alias("value"), F.col("o_orderstatus").alias("unit"))]).groupBy("type", "unit").agg(F.count("*").alias("rows"), F.count("label").alias("labels")), f"{FACTS} SELECT type, unit, count(*) AS rows, count(label) AS labels FROM (SELECT type, unit, label FROM f UNION ALL SELECT 'order', o_orderstatus, NULL FROM orders) GROUP BY ALL")
P.add("company_resolve", lambda r: A.resolve_names(r("part").select(F.explode(letters(F.col("p_name"))).alias("query")), r("part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("market")).agg(F.min("p_partkey").alias("code"))), rf"""WITH q AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\p{{L}}]+'), lambda w: w <> '')) AS query FROM part), k AS (SELECT p_name AS name, p_type AS market, min(p_partkey) AS code FROM part GROUP BY ALL),
s AS (SELECT DISTINCT query, code, name, CASE market WHEN 'STANDARD' THEN 10 WHEN 'ECONOMY' THEN 6 ELSE 4 END + CASE WHEN name = query THEN 2 ELSE 0 END + CASE WHEN ends_with(name, query) THEN 3 ELSE 0 END AS score FROM q JOIN k ON list_contains(regexp_split_to_array(lower(name), '[^\p{{L}}]+'), query) AND contains(name, query))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, code) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
#: Words, their middle parts, single letters and whole names with an addition; known are all names.
P.add("company_resolve_parts", lambda r: A.resolve_parts(r("part").select(F.explode(letters(F.col("p_name"))).alias("w"), "p_name").select(F.explode(F.array("w", F.substring("w", 2, 3), F.substring("w", 1, 1), F.concat("p_name", F.lit("s")))).alias("query")), r("part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("market")).agg(F.min("p_partkey").alias("code")), {"STANDARD": 10, "ECONOMY": 6}, 4), r"""WITH w AS (SELECT p_name, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}]+'), lambda w: w <> '')) AS w FROM part),
q AS (SELECT DISTINCT unnest([w, substr(w, 2, 3), substr(w, 1, 1), p_name || 's']) AS query FROM w), k AS (SELECT p_name AS name, p_type AS market, min(p_partkey) AS code FROM part GROUP BY ALL),
s AS (SELECT query, code, name, market, CASE market WHEN 'STANDARD' THEN 10 WHEN 'ECONOMY' THEN 6 ELSE 4 END + CASE WHEN name = query THEN 2 ELSE 0 END AS score FROM q JOIN k ON query <> '' AND name <> '' AND (contains(name, query) OR contains(query, name)))
SELECT * EXCLUDE (market) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, code, name, market) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
P.add("best_url", lambda r: A.best_url(r("pages"), host_of(F.col("url")), "page=|/fr/", "/en/"), f"SELECT host, arg_max(page_id, (score, official, -page_id)) AS page_id, arg_max(url, (score, official, -page_id)) AS url, max(score) AS score FROM (SELECT {HOST} AS host, page_id, url, CASE WHEN regexp_matches(lower(url), 'page=|/fr/') THEN 3 ELSE 0 END + CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS score, CAST(regexp_matches(lower(url), '/en/') AS INTEGER) AS official FROM pages) GROUP BY host")


def results(r):
    """Pages as results of their host, with the title and the last label of the host but one as target."""
    host = host_of(F.col("url"))
    return r("pages").select(host.alias("host"), F.col("page_id").alias("pos"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.substring(host, 1, 2).alias("target"))


URL_WORDS = {"others": ("der", "que", "on"), "topics": ("the", "and", "en"), "official": ("/en/", ".org"), "good": ("https", "/de/"), "junk": ("page=", "ref=", "#")}
P.add("pick_url", lambda r: A.pick_url(results(r), "host", **URL_WORDS), f"""WITH p AS (
  SELECT {HOST} AS host, page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages
), q AS (
  SELECT *, lower(title) AS t, lower(url) AS u, substr(host, 1, 2) AS target FROM p WHERE starts_with(url, 'http')
), s AS (
  SELECT host, pos, url, contains(u, '/en/') OR contains(u, '.org') AS official, contains(title, 'the') OR contains(title, 'and') OR contains(title, 'en') AS topic,
    (target <> 'der' AND contains(title, 'der')) OR (target <> 'que' AND contains(title, 'que')) OR (target <> 'on' AND contains(title, 'on')) AS foreign_name,
    list_sum(list_transform(['the', 'and', 'en'], lambda k: CASE WHEN contains(t, k) THEN 2 WHEN contains(u, k) THEN 1 ELSE 0 END)) - list_sum(list_transform(['page=', 'ref=', '#'], lambda k: CASE WHEN contains(u, k) THEN 2 ELSE 0 END)) AS words,
    contains(u, 'https') OR contains(u, '/de/') AS good, contains(title, target) AS in_title, contains(url, target) AS in_url FROM q
), z AS (
  SELECT host, pos, url, official, CAST(words + CASE WHEN official THEN 4 WHEN good THEN 2 ELSE 0 END
    + CASE WHEN in_title THEN 3 + CASE WHEN topic THEN 2 WHEN foreign_name THEN -6 ELSE 0 END WHEN in_url THEN 1 + CASE WHEN topic AND NOT foreign_name THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS score FROM s
) SELECT host, arg_max(url, (score, official, -pos)) AS url, max(score) AS score FROM z GROUP BY host""")
SKILLS = [("german", "der", 2), ("german", "die", 1), ("english", "the", 2), ("english", "and", 1), ("french", "les", 2), ("french", "le", 1)]
VALUES = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in SKILLS)
P.add("goal_overlap", lambda r: A.goal_overlap(r("conversations")), r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: length(x) >= 4) AS w FROM conversations) SELECT conv_id, turn, coalesce(list_has_any(w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn)), false) AS overlap FROM w")
#: Words of three letters and stop words as surveyed; no SQL twin.
P.add("goal_overlap_words", lambda r: A.goal_overlap(r("conversations"), 3, A.GOAL_WORD, A.GOAL_STOP))


def latencies(r):
    e = r("events")
    return A.latency_join(e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), "ts"), e.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "ts"), "k", 86_400)


P.add("latency_join", latencies, "WITH b AS (SELECT user_id AS k, ts FROM events WHERE event_type = 'purchase'), j AS (SELECT a.event_id AS id, a.user_id AS k, round((epoch_us(min(b.ts)) - epoch_us(any_value(a.ts))) / 1e6, 3) AS latency FROM events a LEFT JOIN b ON b.k = a.user_id AND b.ts >= a.ts WHERE a.event_type = 'click' GROUP BY a.event_id, a.user_id) SELECT id, k, CASE WHEN latency <= 86400 THEN latency END AS latency FROM j")
PRICES = {"click": "low", "purchase": "high"}
P.add("cost_lookup", lambda r: A.lookup(task_log(r).select("task_id", F.concat_ws("/", F.lit("Vendor"), "model").alias("model")), F.element_at(F.split(F.lower("model"), "/"), -1), PRICES, F.lit("default")).withColumnRenamed("found", "band"), f"{LOG_SQL} SELECT task_id, 'Vendor/' || model AS model, CASE lower(model) WHEN 'click' THEN 'low' WHEN 'purchase' THEN 'high' ELSE 'default' END AS band FROM log")
#: The names of a region's nations are the aliases.
P.add("alias_normalize", lambda r: alias_lookup(r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("n_name")), F.col("n_name"), r("nation").where("n_regionkey = 3").select(F.col("n_name").alias("alias"), F.substring("n_name", 1, 2).alias("value")), F.upper("n_name"), "code"), "SELECT c_custkey, lower(n_name) AS n_name, CASE WHEN n_regionkey = 3 THEN substr(n_name, 1, 2) ELSE upper(n_name) END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey")
K = F.get_json_object
P.add("tagged_json", lambda r: r("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")), "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")


def checks():
    return [("length", F.char_length("text") >= 200), ("marks", F.regexp_count("text", F.lit("[#|]")) < 3), ("ending", F.col("text").endswith("."))]


CHECK_SQL = "WITH c AS (SELECT doc_id, unnest([{'check': 'length', 'ok': coalesce(length(text) >= 200, false)}, {'check': 'marks', 'ok': coalesce(len(regexp_extract_all(text, '[#|]')) < 3, false)}, {'check': 'ending', 'ok': coalesce(ends_with(text, '.'), false)}], recursive := true) FROM documents)"
P.add("register_check", lambda r: A.run_checks(r("documents"), "doc_id", checks()), f"{CHECK_SQL} SELECT * FROM c")
P.add("audit_rollup", lambda r: A.audit_rollup(A.run_checks(r("documents"), "doc_id", checks()), "doc_id"), f"{CHECK_SQL} SELECT doc_id, bool_and(ok) AS passed, coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (NOT ok), '') AS gaps FROM c GROUP BY doc_id")
P.add("chart_topic_filter", lambda r: part_rows(r).where(~F.col("label").rlike("widget") & F.array_contains(letters(F.col("label")), "red")), "SELECT p_name AS label, p_type AS series, p_brand AS unit, p_retailprice AS value, p_size % 20 + 2000 AS year FROM part WHERE NOT contains(p_name, 'widget') AND regexp_matches(lower(p_name), '(^|[^a-z])red([^a-z]|$)')")
P.add("tail_points", lambda r: A.tail_points(r("events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "series", "day"), "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY day DESC) AS INTEGER) AS back FROM (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)) WHERE back <= 240")
P.add("tokens", lambda r: A.token_counts(r("documents")), r"SELECT doc_id, CAST(len(w) AS INTEGER) AS tokens, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: length(x) >= 3) AS w FROM documents)")
P.add("spec_merge_by_title", lambda r: A.merge_by_title(*[r("part").where(c).select("p_partkey", "p_name") for c in ("p_size <= 25", "p_size > 25")], "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_size <= 25 OR p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 25)")
P.add("rejected_source_anti", lambda r: A.without_rejected(r("pages").select("page_id", "url", host_of(F.col("url")).alias("host")), "host", F.col("url").rlike("ref=")).select("page_id", "host"), f"WITH p AS (SELECT page_id, url, {HOST} AS host FROM pages) SELECT page_id, host FROM p WHERE host NOT IN (SELECT host FROM p WHERE contains(url, 'ref='))")

P.add("spec_provenance", lambda r: A.spec_provenance(r("lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("value")), r("orders").select(F.col("o_orderkey").alias("task"), F.concat_ws(" ", F.col("o_totalprice").cast("decimal(18,2)"), "o_orderpriority").alias("text")), "task"), "WITH k AS (SELECT l_orderkey AS task, l_linenumber AS label, l_quantity AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE contains(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || o_orderpriority, CAST(CAST(abs(l_quantity) AS BIGINT) AS VARCHAR))) SELECT * FROM k WHERE task IN (SELECT task FROM k GROUP BY task HAVING count(*) >= 2)")
P.add("schedule_calendar", lambda r: A.schedule_calendar(r("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("start"), (F.col("o_orderkey") % 7 * 60 + 60).cast("int").alias("minutes")), F.col("start") + F.expr("interval 6 hours")), "SELECT o_orderkey AS job_id, o_orderdate + i * (o_orderkey % 7 * 60 + 60) * INTERVAL 1 MINUTE AS due FROM (SELECT *, unnest(generate_series(1, 6)) AS i FROM orders) WHERE i * (o_orderkey % 7 * 60 + 60) <= 360")

QUERIES, ORACLES = P.queries, P.oracles

"""Fact extraction and regression queries; the lexicon of the test tables stands in for the default one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extractor as X2
from tessera.operators import facts as X
from tessera.operators import learn as L
from tessera.operators.texts import sentences
from tessera.plans.audit import SENTENCES
from tessera.plans.binding import Plans

P = Plans()
WORDS = X.Lexicon(size_words=("the", "der", "le", "of"), money_units=("th", "en", "er", "[a-z]"), regions=("and", "die"), loss_words=("not",))
AMOUNT = r"-?[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:[a-z]|th|en|er)"
P.add("extract_market_size", lambda r: X.extract_amounts(sentences(r("documents")), WORDS).groupBy("doc_id").agg(F.count("*").alias("facts"), F.max("value").alias("greatest"), F.count("region").alias("regions")), rf"""WITH {SENTENCES}, a AS (SELECT doc_id, regexp_split_to_array(sentence, '{AMOUNT}') AS pieces, regexp_extract_all(sentence, '{AMOUNT}') AS raw FROM s WHERE regexp_matches(sentence, '{AMOUNT}')),
e AS (SELECT doc_id, raw[i] AS raw, array_to_string(pieces[1:i], ' ') AS before FROM (SELECT *, unnest(generate_series(1, len(raw))) AS i FROM a)),
k AS (SELECT doc_id, TRY_CAST(replace(regexp_extract(raw, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE) AS v, regexp_extract(before, '(?s)^(.*)(?:the|der|le|of)', 1) AS head, substr(before, length(regexp_extract(before, '(?s)^(.*)(?:the|der|le|of)', 1)) + 1) AS tail FROM e WHERE regexp_matches(before, 'the|der|le|of'))
SELECT doc_id, count(*) AS facts, max(CASE WHEN contains(tail, 'not') THEN -abs(v) ELSE v END) AS greatest, count(*) FILTER (regexp_matches(head, 'and|die')) AS regions FROM k GROUP BY doc_id""")
P.add("extract_fixed_segments", lambda r: X.fixed_segments(sentences(r("documents")), [("english", r"the[^0-9]*?([0-9]+)"), ("german", r"der[^0-9]*?([0-9]+)")]), f"""WITH {SENTENCES.replace("SELECT doc_id, unnest(", "SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS sentence FROM (SELECT doc_id, (").replace(") AS sentence FROM documents)", ") AS p FROM documents))")},
m AS (SELECT 'english' AS segment, doc_id, pos, TRY_CAST(regexp_extract(sentence, 'the[^0-9]*?([0-9]+)', 1) AS DOUBLE) AS value FROM s UNION ALL SELECT 'german', doc_id, pos, TRY_CAST(regexp_extract(sentence, 'der[^0-9]*?([0-9]+)', 1) AS DOUBLE) FROM s) SELECT segment, arg_min(value, (doc_id, pos)) AS value FROM m WHERE value IS NOT NULL GROUP BY segment""")

P.add("extract_source_segments", lambda r: X.fixed_segments(sentences(r("documents")).join(r("documents").select("doc_id", "source"), "doc_id"), [("english", r"the[^0-9]*?([0-9]+)"), ("german", r"der[^0-9]*?([0-9]+)")], ["source"]), P.oracles["extract_fixed_segments"].replace("SELECT segment, arg_min(value, (doc_id, pos)) AS value FROM m WHERE value IS NOT NULL GROUP BY segment", "SELECT source, segment, arg_min(value, (doc_id, pos)) AS value FROM m JOIN documents USING (doc_id) WHERE value IS NOT NULL GROUP BY source, segment"))


def told(r):
    """Amounts with a unit and addresses of every document, by the table function in SQL."""
    X2.register(r("documents").sparkSession)
    return r("documents").sparkSession.sql(
        f"SELECT d.doc_id, f.* FROM {{docs}} d, LATERAL extract_facts(d.text, 'value double, unit string', map('amount', r'{AMOUNTS}', 'address', r'{ADDRESS}')) f", docs=r("documents")
    )


AMOUNTS, ADDRESS = r"(?P<value>[0-9][0-9,]*(?:\.[0-9]+)?)\s*(?P<unit>th|en|er|[a-z])", r"(?P<unit>[A-Za-z0-9._]+@[A-Za-z0-9.]+)"
P.add("extractor_udtf", told, rf"""WITH {SENTENCES.replace("SELECT doc_id, unnest(", "SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS sentence FROM (SELECT doc_id, (").replace(") AS sentence FROM documents)", ") AS p FROM documents))")},
a AS (SELECT doc_id, pos, unnest(regexp_extract_all(sentence, '[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:th|en|er|[a-z])')) AS m FROM s),
e AS (SELECT doc_id, pos, unnest(regexp_extract_all(sentence, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS m FROM s)
SELECT doc_id, 'amount' AS type, CAST(pos AS BIGINT) AS pos, TRY_CAST(replace(regexp_extract(m, '^[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE) AS value, regexp_extract(m, '[a-z]+$') AS unit FROM a
UNION ALL SELECT doc_id, 'address', CAST(pos AS BIGINT), NULL, m FROM e""")
P.add("fact_table", lambda r: X.all_facts(r("documents"), WORDS).groupBy("type").agg(F.count("*").alias("facts")))


def prices(r):
    return r("lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), F.col("l_extendedprice").cast("double").alias("price"))


def train():
    """Four fifths of the orders, by key."""
    return F.col("l_orderkey") % 5 != 0


P.add("train_eval_linear", lambda r: L.line_fit(prices(r), "quantity", "price", train()).select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "rows", F.round("rmse", 2).alias("rmse")), """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem WHERE l_orderkey % 5 <> 0)
SELECT round(any_value(slope), 4) AS slope, round(any_value(intercept), 2) AS intercept, count(*) AS rows, round(sqrt(avg(power(l_extendedprice - (slope * l_quantity + intercept), 2))), 2) AS rmse FROM lineitem, f WHERE l_orderkey % 5 = 0""")
#: The normal equations of three features, solved by determinants.
P.add("train_eval_features", lambda r: L.train_eval(prices(r), ["quantity", "discount", "tax"], "price", train()).select("model", F.round("rmse", 2).alias("rmse"), "r2", "feature", F.round("weight", 2).alias("weight")), """WITH l AS (
  SELECT l_orderkey % 5 <> 0 AS train, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS c, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
), m AS (
  SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM l WHERE train
), d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m), w AS (
  SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS wa, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS wb, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS wc FROM d
), e AS (
  SELECT y, y - (my + wa * (a - ma) + wb * (b - mb) + wc * (c - mc)) AS miss FROM l, w WHERE NOT train
), s AS (SELECT round(sqrt(avg(miss * miss)), 2) AS rmse, round(1 - sum(miss * miss) / (count(*) * var_pop(y)), 4) AS r2 FROM e)
SELECT 'linear' AS model, rmse, r2, f.name AS feature, round(f.weight, 2) AS weight FROM s, (SELECT unnest([{'name': 'quantity', 'weight': wa}, {'name': 'discount', 'weight': wb}, {'name': 'tax', 'weight': wc}]) AS f FROM w)""")
P.add("train_eval_forest", lambda r: L.train_eval(prices(r), ["quantity", "discount", "tax"], "price", train(), forest=True))

QUERIES, ORACLES = P.queries, P.oracles

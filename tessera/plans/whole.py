"""The rules of checks and routing over whole tables of texts, pages, labels and JSON; word lists are those of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import checks as C
from tessera.operators import routing as R
from tessera.plans.audit import SENTENCES
from tessera.plans.binding import Plans, Reader

P = Plans()
#: SQL of the same helpers: without white space at both ends, and how often a word occurs.
STRIP = r"regexp_replace({0}, '^[\s　]+|[\s　]+$', '', 'g')"
TIMES = "CAST((length({0}) - length(replace({0}, '{1}', ''))) / {2} AS INTEGER)"
MARKS, LISTS = ["%%%", "###", "und"], ["web", "shop", "the"]


P.add("completeness_documents", lambda r: r("documents").select("doc_id", C.completeness(F.col("text"), F.col("source"), MARKS, LISTS).alias("s")).select("doc_id", "s.*"), f"""WITH c AS (
  SELECT doc_id, {" + ".join(TIMES.format("coalesce(text, '')", m, len(m)) for m in MARKS)} AS marks, regexp_matches(coalesce(text, ''), '(?m)^[ \\t]*\\|.*\\|') AS has_table, coalesce(regexp_matches(lower(source), '{"|".join(LISTS)}'), false) AS list_wanted FROM documents
) SELECT doc_id, marks < 3 AND NOT (list_wanted AND NOT has_table) AS passed, marks, has_table, false AS all_marks, list_wanted FROM c""")
P.add("gap_marks_documents", lambda r: r("documents").select("doc_id", F.array_join(C.gap_marks(F.col("text"), ["@", "http", "License", "###", "…"]), "|").alias("gaps")), "SELECT doc_id, array_to_string(list_filter(['@', 'http', 'License', '###', '…'], lambda m: contains(coalesce(text, ''), m)), '|') AS gaps FROM documents")
P.add("unsafe_documents", lambda r: r("documents").select("doc_id", F.array_join(C.unsafe_words(F.col("text"), ["thth", "Über", "ción", "key"]), "|").alias("found")), "SELECT doc_id, array_to_string(list_filter(['thth', 'Über', 'ción', 'key'], lambda m: contains(coalesce(text, ''), m)), '|') AS found FROM documents")
P.add("too_short_documents", lambda r: r("documents").select("doc_id", C.too_short(F.col("text")).alias("short")), f"""WITH t AS (
  SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS t FROM documents
) SELECT doc_id, length(t) < 50 OR (starts_with(t, '{{') AND regexp_matches(lower(t), '"(error|status|detail|message)"')) OR (length(t) < 300 AND length({STRIP.format("regexp_replace(t, '(?m)^#.*$', '', 'g')")}) < 50) AS short FROM t""")
P.add("too_short_turns", lambda r: r("conversations").select("conv_id", "turn", C.too_short(F.col("text")).alias("short")), f"""WITH t AS (
  SELECT conv_id, turn, {STRIP.format("coalesce(text, '')")} AS t FROM conversations
) SELECT conv_id, turn, length(t) < 50 OR (starts_with(t, '{{') AND regexp_matches(lower(t), '"(error|status|detail|message)"')) OR (length(t) < 300 AND length({STRIP.format("regexp_replace(t, '(?m)^#.*$', '', 'g')")}) < 50) AS short FROM t""")
P.add("injection_documents", lambda r: r("documents").select("doc_id", R.injection_label(F.col("text"), [("licence", r"licen[cs]e|copyright"), ("mail", r"[a-z]+@[a-z]+"), ("number", r"[0-9]{3,}\s+[a-z]"), *R.INJECTIONS]).alias("label")), r"""WITH t AS (SELECT doc_id, substr(coalesce(text, ''), 1, 20000) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)licen[cs]e|copyright') THEN 'licence' WHEN regexp_matches(t, '(?i)[a-z]+@[a-z]+') THEN 'mail' WHEN regexp_matches(t, '(?i)[0-9]{3,}\s+[a-z]') THEN 'number' WHEN regexp_matches(t, '(?i)system prompt') THEN '角色扮演/系统提示泄露'
WHEN regexp_matches(t, '(?i)(?:UPDATE|DROP|DELETE|INSERT|ALTER)\s+[A-Za-z_]') OR regexp_matches(t, '(?i);\s*--|\bUNION\s+SELECT\b') THEN 'SQL 注入' WHEN regexp_matches(t, '(?i)\$\s*\(|`[^`]{2,}`') THEN '命令注入' WHEN regexp_matches(t, '(?i)base64\s*[-_]\s*d|b64decode|fromCharCode') THEN '编码混淆' WHEN regexp_matches(t, '(?i)curl\s+\S+|wget\s+\S+|powershell\s+-') THEN '命令注入' END AS label FROM t""")
P.add("wants_chart_turns", lambda r: r("conversations").select("conv_id", "turn", R.wants_chart(F.col("text"), ["plot", "chart", "graph", "then", "über"]).alias("wanted")), "SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), 'plot|chart|graph|then|über') AS wanted FROM conversations")
P.add("task_domain_turns", lambda r: r("conversations").select("conv_id", "turn", R.trace_domain(F.col("text"), [("crypto", ["eth", "coin"]), ("macro", ["gdp", "ción"]), ("news", ["news", "ung"]), ("financial", ["revenue", "ent"])]).alias("domain")), "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'eth|coin') THEN 'crypto' WHEN regexp_matches(lower(text), 'gdp|ción') THEN 'macro' WHEN regexp_matches(lower(text), 'news|ung') THEN 'news' WHEN regexp_matches(lower(text), 'revenue|ent') THEN 'financial' ELSE 'research' END AS domain FROM conversations")
P.add("topic_gate_documents", lambda r: R.topic_gate(r("documents").select("doc_id", "text", F.array(F.lit("with"), F.lit("mit"), F.lit("ción")).alias("anchors"))).select("doc_id", "pos", "sentence"), f"""WITH {SENTENCES.replace("SELECT doc_id, unnest(", "SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS sentence FROM (SELECT doc_id, (").replace(") AS sentence FROM documents)", ") AS p FROM documents))")}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM s WHERE list_has_any(regexp_split_to_array(lower(sentence), '[^a-z0-9]+'), ['with', 'mit']) OR contains(lower(sentence), 'ción')""")


def titles(r: Reader) -> DataFrame:
    return r("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


TITLES = "t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"
P.add("short_label_pages", lambda r: titles(r).select("page_id", C.short_label(F.col("title"), F.element_at(F.split("title", " "), -1), F.col("url")).alias("short")), rf"""WITH {TITLES}, l AS (
  SELECT page_id, url, CASE WHEN {STRIP.format("title")} = '' THEN '?' ELSE {STRIP.format("title")} END AS label, {STRIP.format("string_split(title, ' ')[-1]")} AS caliber FROM t
), h AS (
  SELECT *, list_filter(list_transform([[c, m] FOR c IN [caliber, label] FOR m IN ['，', ',', '；', ';', '：', ':', '（', '(']], lambda x: {STRIP.format("string_split(x[1], x[2])[1]")}), lambda x: x <> '' AND length(x) <= 12) AS heads FROM l
) SELECT page_id, CASE WHEN length(label) <= 12 THEN label ELSE coalesce(heads[1], CASE WHEN regexp_extract(url, 'https?://([^/]+)', 1) <> '' THEN substr(replace(regexp_extract(url, 'https?://([^/]+)', 1), 'www.', ''), 1, 12) END, substr(label, 1, 12)) END AS short FROM h""".replace("[[c, m] FOR c IN [caliber, label] FOR m IN ['，', ',', '；', ';', '：', ':', '（', '(']]", "[" + ", ".join(f"[{c}, '{m}']" for c in ("caliber", "label") for m in "，,；;：:（(") + "]"))
P.add("noise_label_pages", lambda r: titles(r).select("page_id", C.noise_label(F.col("title"), ["%%%", "***", " -", "the"]).alias("noise")), f"WITH {TITLES} SELECT page_id, contains(title, '%%%') OR contains(title, '***') OR contains(title, ' -') OR contains(title, 'the') AS noise FROM t")
P.add("title_key_pages", lambda r: titles(r).select("page_id", C.title_key(F.col("title")).alias("key")), rf"WITH {TITLES} SELECT page_id, lower(regexp_replace(regexp_replace(title, '[（(][^）)]*[）)]', '', 'g'), '[年月日：:，,。．\-·\s]+', '', 'g')) AS key FROM t")

#: What the properties of events must hold, by kind of event.
CONTRACTS = {"click": C.Contract(("k", "v")), "purchase": C.Contract(("k",), ("failed",)), "view": C.Contract((), (), 0, "k")}
P.add("contract_events", lambda r: r("events").select("event_id", F.array_join(C.contract_issues(F.col("event_type"), F.col("props"), CONTRACTS), "|").alias("issues")), """WITH k AS (SELECT event_id, event_type, coalesce(trim(json_extract_string(props, '$.k')), '') AS k, coalesce(trim(json_extract_string(props, '$.v')), '') AS v FROM events)
SELECT event_id, CASE event_type WHEN 'click' THEN array_to_string(list_filter([CASE WHEN k = '' THEN 'lacks k' END, CASE WHEN v = '' THEN 'lacks v' END], lambda x: x IS NOT NULL), '|') WHEN 'purchase' THEN CASE WHEN k = '' THEN 'lacks k' ELSE '' END ELSE '' END AS issues FROM k""")
P.add("loose_json_events", lambda r: r("events").select("event_id", C.balanced_json(F.concat(F.lit("answer: "), F.col("props"), F.lit(" done"))).alias("found")), "SELECT event_id, props AS found FROM events")


def letters_and_digits(text: str | None, lang: str | None) -> tuple[bool, str]:
    """Whether a text has letters and a language; raises on an empty language."""
    return text is not None and any(c.isalpha() for c in text), lang.upper()


def registered(r: Reader) -> DataFrame:
    rules = [A.Check("long", F.char_length("text") >= 200), A.Check("letters", A.python_check(letters_and_digits, "text", "lang"), ("en", "de")), A.Check("clean", ~F.col("text").contains("###"), ("de",))]
    found = A.registered_checks(r("documents").select("doc_id", "text", "lang"), "doc_id", F.array(F.col("lang"), F.lit("any")), rules)
    return found.select("doc_id", "check", "ok", "detail")


P.add("registered_checks_documents", registered, r"""SELECT doc_id, 'long' AS "check", coalesce(length(text) >= 200, false) AS ok, NULL::VARCHAR AS detail FROM documents
UNION ALL SELECT doc_id, 'letters', regexp_matches(text, '\p{L}'), upper(lang) FROM documents WHERE lang IN ('en', 'de')
UNION ALL SELECT doc_id, 'clean', coalesce(NOT contains(text, '###'), false), NULL FROM documents WHERE lang = 'de'""")

QUERIES, ORACLES = P.queries, P.oracles

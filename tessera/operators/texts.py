"""Text jobs: filters, tokens, sentences, numbers, hashes and rules, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import nearest_exact


def host_of(url: Column) -> Column:
    """Host without scheme and www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def source_distribution(pages: DataFrame, deny: str, top: int = 12) -> DataFrame:
    """The hosts with most pages outside the deny pattern."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where((F.col("host") != "") & ~F.col("host").contains(deny))
    return hosts.groupBy("host").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "host").limit(top)


def garbage_filter(pages: DataFrame, deny_host: str, deny_path: str) -> DataFrame:
    return pages.where(~host_of(F.col("url")).contains(deny_host) & ~F.lower("url").rlike(deny_path))


def letters(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def topic_terms(docs: DataFrame, stop: list[str], least: int = 3, top: int = 12) -> DataFrame:
    words = docs.select(F.explode(letters(F.col("text"))).alias("term")).where((F.char_length("term") >= least) & ~F.col("term").isin(stop))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence): split at semicolons, line ends and full stops; a "." next to a digit belongs to the number."""
    pieces = F.split("text", r"[。．；;\n]|(?<![0-9])\.(?![0-9])")
    parts = F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "sentence"))


NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def extract_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, number): digits with separators removed, addresses masked first."""
    masked = F.regexp_replace("text", r"https?://[^ \n]+", " ")
    raw = docs.select("doc_id", F.explode(F.regexp_extract_all(masked, F.lit(f"({NUMBER})"), 1)).alias("raw"))
    number = F.replace(F.col("raw"), F.lit(","), F.lit("")).try_cast("double")
    return raw.select("doc_id", number.alias("number")).where("number is not null")


def content_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("content_hash"), F.md5(F.substring("text", 1, 500)).alias("cache_key"))


def dedupe_first(docs: DataFrame, chars: int = 80) -> DataFrame:
    """The first row (least id) of each leading text."""
    return docs.groupBy(F.substring("text", 1, chars).alias("lead")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def script_ratio_flag(docs: DataFrame, pattern: str, least: float, chars: int) -> DataFrame:
    """Long texts with too few characters of the expected script."""
    share = F.regexp_count("text", F.lit(pattern)) / F.char_length("text")
    return docs.where(F.char_length("text") > chars).select("doc_id", F.round(share, 6).alias("share"), (share < least).alias("gibberish"))


def md_summary(docs: DataFrame, chars: int = 300) -> DataFrame:
    """Markup stripped, blanks collapsed, cut with an ellipsis."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[#*`>|_]", ""), r"[ \t\n\r]+", " "))
    return docs.select("doc_id", F.when(F.char_length(plain) > chars, F.concat(F.substring(plain, 1, chars), F.lit("..."))).otherwise(plain).alias("summary"))


def html_to_text(pages: DataFrame, chars: int = 30_000) -> DataFrame:
    """Title and visible text; scripts, styles and navigation dropped."""
    body = F.regexp_replace("html", r"(?is)<(script|style|noscript|iframe|svg|nav|footer)[^>]*>.*?</(script|style|noscript|iframe|svg|nav|footer)>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return pages.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.substring(text, 1, chars).alias("text"))


def char_ngrams(texts: DataFrame, n: int) -> DataFrame:
    """(item_id, gram, times) over sliding windows of characters."""
    size = F.char_length("text")
    grams = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("text", i, F.lit(n))))
    return texts.select("item_id", F.explode(grams).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("times"))


def search_matches(goals: DataFrame, docs: DataFrame, least: int = 6, top: int = 3) -> DataFrame:
    """For each goal the documents that share most distinct tokens; an equi-join on tokens, best ``top`` kept.

    Tokens under ``least`` letters are left out: they are frequent and say little.
    """
    token = lambda df, key: df.select(key, F.explode(F.array_distinct(letters(F.col("text")))).alias("token")).where(F.char_length("token") >= least)
    wanted = token(goals, "item_id")
    hits = token(docs, "doc_id").join(wanted, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


HAN = "\u4e00-\u9fff"
#: Letters and digits other than Han characters; a word ends where they end.
ALNUM = rf"[\p{{L}}\p{{Nd}}&&[^{HAN}]]"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _han_grams(text: Column) -> list[Column]:
    """All windows of 2 to 4 characters inside runs of Han characters."""
    return [_found(text, f"(?=([{HAN}]{{{n}}}))", 1) for n in (2, 3, 4)]


def content_tokens(text: Column, stop: list[str], fragments: str, least: int = 2) -> Column:
    """Tokens for counting: pairs of Han characters without a fragment character, and words of at least so many letters or digits; numbers and stop words go."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pairs = _found(low, f"[{HAN}]{{2}}")
    if fragments:
        pairs = F.filter(pairs, lambda w: ~w.rlike(f"[{fragments}]"))
    words = F.filter(_found(low, ALNUM + "+"), lambda w: (F.char_length(w) >= least) & ~w.rlike("^[0-9]+$"))
    return F.filter(F.concat(pairs, words), lambda w: ~F.array_contains(F.array(*map(F.lit, stop)).cast("array<string>"), w))


def goal_tokens(text: Column) -> Column:
    """What a goal asks for: Han 2/3/4-grams, runs of four digits, words from 3 characters (hyphens belong to the word)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = _found(low, rf"[\p{{L}}&&[^{HAN}]](?:{ALNUM}|-){{2,}}")
    return F.array_distinct(F.concat(*_han_grams(low), _found(low, "[0-9]{4}"), words))


def text_tokens(text: Column, parts: int) -> Column:
    """Every token that a goal can find in a text; hyphenated words up to so many parts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = [_found(low, ALNUM + "+")]
    pieces = F.transform(_found(low, rf"(?:{ALNUM}|-)*-(?:{ALNUM}|-)*"), lambda run: F.split(run, "-"))
    for n in range(2, parts + 1):
        joined = lambda p: F.when(F.size(p) >= n, F.transform(F.sequence(F.lit(1), F.size(p) - n + 1), lambda i: F.array_join(F.slice(p, i, n), "-"))).otherwise(F.array().cast("array<string>"))  # noqa: B023,E731
        words.append(F.flatten(F.transform(pieces, joined)))
    return F.array_distinct(F.concat(*_han_grams(low), _found(low, "(?=([0-9]{4}))", 1), *words))


def token_weight(token: Column) -> Column:
    """1 for Han bigrams and years, 2 for longer Han grams and words."""
    return F.when(token.rlike(f"^([{HAN}]{{2}}|[0-9]{{4}})$"), 1).otherwise(2)


#: Tokens of goals that are sent to every worker; more stay a table and are joined.
HELD_TOKENS = 500_000


def search_scores(goals: DataFrame, docs: DataFrame, top: int = 3, least: int = 2, salts: int = 8, held: int = HELD_TOKENS) -> DataFrame:
    """(item_id, doc_id, score, rank): the best ``top`` documents (one row for each doc_id) of each goal by the weights of its tokens that they hold.

    Documents under the ``least`` score are left out, unless a goal has none above it. No token is dropped. Up to ``held`` tokens of goals
    go to the workers, which score their documents batch by batch and hand on the best of each goal, so no pair of a goal and a document is shuffled
    or kept. More tokens are joined: the goal side is repeated for each salt, so the rows of a frequent token are dealt over several tasks.
    """
    wanted = goals.select("item_id", F.explode(goal_tokens(F.col("text"))).alias("token"))
    parts, count = wanted.agg(F.max(F.size(F.split("token", "-"))), F.count("*")).first()
    wanted = wanted.distinct().select("item_id", "token", token_weight(F.col("token")).alias("weight"))
    if count <= held:
        best = docs.select("doc_id", text_tokens(F.col("text"), parts or 1).alias("tokens")).mapInArrow(best_by_tokens(wanted.toArrow(), top), "item_id long, doc_id long, score long")
    else:
        wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        said = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.explode(text_tokens(F.col("text"), parts or 1)).alias("token"))
        best = said.join(wanted, ["token", "salt"]).groupBy("item_id", "doc_id").agg(F.sum("weight").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    strict = F.max("score").over(Window.partitionBy("item_id")) >= least
    return best.withColumn("strict", strict).where(~F.col("strict") | (F.col("score") >= least)).drop("strict")


def best_by_tokens(wanted: pa.Table, top: int, cells: int = 1_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches of documents (doc_id, tokens) that gives the best ``top`` of them for each item of (item_id, token, weight), about ``cells`` scores at a time."""
    wanted = wanted.filter(pc.is_valid(wanted["item_id"])).sort_by("token")
    items, item = np.unique(wanted["item_id"].to_numpy(), return_inverse=True)
    weight, words = wanted["weight"].to_numpy(), pc.unique(wanted["token"])
    starts = np.append(np.flatnonzero(np.diff(pc.index_in(wanted["token"], words).to_numpy(), prepend=-1)), len(item)).astype(np.int64)

    def shrink(i, doc, score):
        place = np.lexsort((doc, -score, i))
        i, doc, score = i[place], doc[place], score[place]
        best = np.arange(len(i)) - np.searchsorted(i, i) < top
        return i[best], doc[best], score[best]

    def run(batches):
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, cells // max(1, len(items)))):
                b = whole.slice(at, max(1, cells // max(1, len(items))))
                known = pc.index_in(pc.list_flatten(b.column("tokens")), words)
                found, row = pc.fill_null(known, -1).to_numpy(zero_copy_only=False), pc.list_parent_indices(b.column("tokens")).to_numpy()
                row, found = row[found >= 0], found[found >= 0]
                times = starts[found + 1] - starts[found]
                spot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[found], times)
                scores = np.bincount(np.repeat(row, times) * len(items) + item[spot], weight[spot], b.num_rows * len(items)).astype(np.int64)
                hit = np.flatnonzero(scores)
                doc = b.column("doc_id").to_numpy(zero_copy_only=False)[hit // max(1, len(items))].astype(np.int64)
                best = shrink(*(np.concatenate(c) for c in zip(best, (hit % max(1, len(items)), doc, scores[hit]), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(items[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.int64())], ["item_id", "doc_id", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, most: float, per_block: int = 1024, per_part: int = 8192) -> DataFrame:
    """The k nearest vectors of each query by cosine distance of unit vectors, itself excluded; ties go to the lesser id.

    The query side is a stated set. Queries are dealt into blocks of about ``per_block``, vectors into parts of about ``per_part``; every
    block meets every part in a task of its own, which multiplies matrices to find what may be among the nearest and works out
    only those distances term by term, so it holds a bounded number of rows and hands on k of them for each query. The work grows with
    queries times vectors. Null vectors, and pairs of different lengths, are left out.
    """
    held = lambda df: df.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("size"))
    asked, known = held(queries), held(vectors)
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((asked, per_block), (known, per_part)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", deal(blocks)).withColumn("part", every(parts))
    right = known.withColumn("part", deal(parts)).withColumn("block", every(blocks))
    place = ["block", "part", "size"]
    near = left.groupBy(place).cogroup(right.groupBy(place)).applyInArrow(lambda key, a, b: nearest_exact(key[2].as_py(), a, b, k, most), "vec_id long, other long, distance double")
    order = Window.partitionBy("vec_id").orderBy("distance", "other")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Dictionaries as tables: names mentioned in texts under any of their aliases, and values looked up by alias.

An alias of ASCII letters (two or more) counts as a whole word in any case; any other counts anywhere, case by case and without
overlaps. Aliases of a name that differ in case only count once. Null and empty aliases and null texts hold nothing.

A dictionary of up to ROWS aliases and TEXT characters is sent to the workers, each of which builds two Aho-Corasick automata once and passes
over every text in one go. A larger one stays a table: words meet it by equality, other aliases by their first two characters
(one, if they have no more), and a candidate is compared in full where it was found.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary of at most so many aliases and characters goes to every worker.
ROWS, TEXT = 500_000, 16_000_000
_WORD = "^[A-Za-z]{2,}$"
_AUTOMATA: dict[str, tuple] = {}


def _clean(aliases: DataFrame) -> DataFrame:
    """(alias, name, word) without doublets; words in lower case."""
    rows = aliases.where("alias <> '' and name is not null").select("alias", "name", F.col("alias").rlike(_WORD).alias("word"))
    return rows.groupBy(F.lower("alias").alias("low"), "name").agg(F.min_by(F.struct("alias", "word"), F.struct("word", "alias")).alias("s")).select(F.when(F.col("s.word"), F.col("low")).otherwise(F.col("s.alias")).alias("alias"), "name", "s.word")


def _automata(rows: list[tuple[str, str, bool]]) -> tuple:
    """One automaton of words and one of other aliases; a value is (length, names)."""
    out = []
    for word in (True, False):
        names: dict[str, list[str]] = {}
        for alias, name, is_word in rows:
            if is_word == word:
                names.setdefault(alias, []).append(name)
        found = ahocorasick.Automaton()
        for alias, own in names.items():
            found.add_word(alias, (len(alias), own))
        if names:
            found.make_automaton()
        out.append(found if names else None)
    return tuple(out)


def _letter(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _counts(text: str, automata: tuple) -> dict[str, int]:
    counts: dict[str, int] = {}
    words, others = automata
    if words is not None:
        low = "".join(c.lower() if c.isascii() else c for c in text) if not text.isascii() else text.lower()
        for last, (size, names) in words.iter(low):
            start = last - size + 1
            if (start == 0 or not _letter(low[start - 1])) and (last + 1 == len(low) or not _letter(low[last + 1])):
                for n in names:
                    counts[n] = counts.get(n, 0) + 1
    if others is not None:
        ends: dict[int, int] = {}
        for last, found in others.iter(text):
            size, names = found
            if last - size >= ends.get(id(found), -1):  # behind the end of the alias's last occurrence that counted
                ends[id(found)] = last
                for n in names:
                    counts[n] = counts.get(n, 0) + 1
    return counts


def _by_automata(docs: DataFrame, rows: list, key: str) -> DataFrame:
    mark, spread = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        if mark not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[mark] = _automata(spread.value)
        for b in batches:
            at, names, counts = [], [], []
            for i, text in enumerate(b.column("text_")):
                found = _counts(text.as_py() or "", _AUTOMATA[mark])
                at += [i] * len(found)
                names += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays([b.column("key_").take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["key_", "name", "mentions"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key_"), F.col("text").alias("text_")).mapInArrow(run, f"key_ {kind}, name string, mentions long")


def _by_joins(docs: DataFrame, known: DataFrame, key: str, longest: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w.rlike("^[a-z]{2,}$"))
    said = docs.select(F.col(key).alias("key_"), F.explode(words).alias("alias")).groupBy("key_", "alias").agg(F.count("*").alias("n"))
    whole = said.join(known.where("word").select("alias", "name"), "alias").select("key_", "name", "n")
    others = known.where("not word").withColumn("start", F.substring("alias", 1, 2))
    # every place of a text (in UTF-16 units) with the characters that an alias there could have
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), F.col(key).alias("key_"), text.alias("text_")).where("text_ <> ''")
    places = rows.select("row_", "key_", F.posexplode(F.regexp_extract_all("text_", F.lit(f"(?s)(?=(.{{1,{longest}}}))"), F.lit(1))).alias("pos", "window"))
    starts = places.select("*", F.explode(F.array_distinct(F.array(F.substring("window", 1, 2), F.substring("window", 1, 1)))).alias("start"))
    starts = starts.join(others.select("start").distinct(), "start", "left_semi")
    met = starts.join(others, "start").where(F.startswith("window", "alias"))
    ends = met.groupBy("row_", "key_", "name", "alias").agg(F.sort_array(F.collect_list("pos")).alias("places"))  # at most the places of one text
    units = (F.octet_length(F.encode("alias", "UTF-16BE")) / 2).cast("int")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("free"))
    step = lambda acc, pos: F.when(pos >= acc["free"], F.struct((acc["n"] + 1).alias("n"), (pos + units).alias("free"))).otherwise(acc)
    return whole.unionAll(ends.select("key_", "name", F.aggregate("places", zero, step)["n"].alias("n")))


def alias_mentions(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", rows: int = ROWS, chars: int = TEXT) -> DataFrame:
    """(key, name, mentions) of the names of ``aliases`` (alias, name) found in each text of ``docs`` (key, text)."""
    known = _clean(aliases)
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("alias") + F.char_length("name")), F.lit(0)).alias("chars"), F.max(F.char_length("alias")).alias("longest")).first()
    if size.n <= rows and size.chars <= chars:
        found = _by_automata(docs, [tuple(r) for r in known.collect()], key)
        return found.groupBy("key_", "name").agg(F.sum("mentions").alias("mentions")).withColumnRenamed("key_", key)
    return _by_joins(docs, known, key, size.longest).groupBy("key_", "name").agg(F.sum("n").alias("mentions")).withColumnRenamed("key_", key)


def alias_lookup(df: DataFrame, asked: Column, aliases: DataFrame, default: Column, name: str = "found") -> DataFrame:
    """``df`` with the value that a dictionary (alias, value) gives for ``asked`` in any case, else the default; the least value of a repeated alias."""
    known = aliases.where("alias is not null").groupBy(F.lower("alias").alias("alias_")).agg(F.min("value").alias("value_"))
    return df.withColumn("asked_", F.lower(asked)).join(known, F.col("asked_") == F.col("alias_"), "left").withColumn(name, F.coalesce("value_", default)).drop("asked_", "alias_", "value_")

"""Language identification by compression.

For every learned language a zstandard raw-content dictionary is filled with the words of sample texts, the
commonest last, where matches are cheapest; a word goes to the language that uses it in the largest share
of documents, so passages quoted in another language do no harm. A text is lower-cased and compressed whole, in
blocks of BLOCK bytes (so that a long text is compared with the dictionaries and not with itself), with each
dictionary; the language with the smallest total size wins. Every block is followed by the same short pad, without
which zstandard stores short blocks as they are. The answer is rejected where the margin to the second language is narrow.

Bounds of training (parameters): at most ``sample_docs`` documents of a language, ``sample_chars``
characters of each, ``dict_bytes`` of dictionary, ``most_languages`` languages. Documents are picked by a hash of id and text.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0 and rejected; with one
learned language the margin is 1; with none every text is ``und``; equal sizes go to the first language by name; null and
repeated ids keep their rows (equal rows are learned once); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.io import cut_lineage

LETTER, WORD = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+")
#: Level of compression, bytes of text in a block, and what follows each block.
LEVEL, BLOCK, PAD = 12, 512, b"\n" * 32
#: Narrowest margin, as a share of the second size, that is accepted.
MARGIN = 0.003


def train(df: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", sample_docs: int = 300, sample_chars: int = 2000, dict_bytes: int = 1 << 16, most_languages: int = 1000) -> dict[str, bytes]:
    """Dictionary content for each language of the rows given.

    Only marks are ranked; the row limit in the window is applied before the shuffle. Texts are fetched by a broadcast
    of the ranked marks, whose number is checked, so that no text is shuffled but the chosen ones. The texts that come
    to the driver are at most sample_docs * sample_chars characters for each language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang_"), F.col(text).alias("text_"), F.xxhash64(id_col, lang, text).alias("mark_"))
    ranked = rows.select("lang_", "mark_", F.row_number().over(Window.partitionBy("lang_").orderBy("mark_")).alias("rank_"))
    first = cut_lineage(ranked.where(F.col("rank_") <= sample_docs).select("mark_").distinct())
    if (n := first.count()) > sample_docs * most_languages:
        raise ValueError(f"{n} training rows are chosen; more than {most_languages} languages cannot be learned")
    chosen = rows.join(F.broadcast(first), "mark_", "left_semi")  # at most sample_docs * most_languages numbers
    chosen = chosen.select("lang_", "mark_", F.substring("text_", 1, sample_chars).alias("start_")).distinct()
    texts: dict[str, list[str]] = {}
    for r in sorted(chosen.collect()):
        texts.setdefault(r["lang_"], []).append(r["start_"])
    return contents(texts, dict_bytes)


def contents(texts: dict[str, list[str]], dict_bytes: int = 1 << 16) -> dict[str, bytes]:
    """Dictionary content by language: its own words by the share of documents that use them."""
    share: dict[str, dict[str, float]] = {}
    for lang, docs in texts.items():
        seen = Counter(w for d in docs for w in set(words(d)))
        share[lang] = {w: n / len(docs) for w, n in seen.items()}
    out = {}
    for lang in sorted(share):
        own = [w for w, x in share[lang].items() if all(x >= other.get(w, 0) for other in share.values())]
        own.sort(key=lambda w: (share[lang][w], w))
        out[lang] = " ".join(own).encode()[-dict_bytes:]
    return out


def words(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return WORD.findall(text.lower())


class Compressors:
    """One compressor for each language."""

    def __init__(self, content: dict[str, bytes]):
        self.by: dict[str, zstandard.ZstdCompressor] = {}
        for lang, data in content.items():
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.by[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> dict[str, int]:
        """Compressed bytes of the whole text by language."""
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] + PAD for i in range(0, len(data), BLOCK)]
        return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in self.by.items()}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (a soft minimum over the sizes) and margin."""
        if not text or not self.by or not LETTER.search(text):
            return "und", 0.0, 0.0
        ranked = sorted((n, lang) for lang, n in self.sizes(text).items())
        best = ranked[0][0]
        margin = (ranked[1][0] - best) / ranked[1][0] if len(ranked) > 1 else 1.0
        return ranked[0][1], 1 / sum(math.exp(-(n - best) / 8) for n, _ in ranked), margin


def prediction_column(content: dict[str, bytes], text: str = "text", min_margin: float = MARGIN) -> Column:
    """struct(lang_pred, score, margin, accepted) of a text column."""

    @F.pandas_udf("lang_pred string, score double, margin double, accepted boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = _compressors(tuple(content.items()))
        out = pd.DataFrame([known.predict(t) for t in texts], columns=["lang_pred", "score", "margin"])
        return out.assign(accepted=(out["lang_pred"] != "und") & (out["margin"] >= min_margin))

    return run(F.col(text))


@functools.lru_cache(maxsize=1)
def _compressors(items: tuple) -> Compressors:
    return Compressors(dict(items))


def predict(df: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text: str = "text", min_margin: float = MARGIN) -> DataFrame:
    """(id, lang_pred, score, margin, accepted) of every row."""
    return df.select(id_col, prediction_column(content, text, min_margin).alias("x")).select(id_col, "x.*")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo parts; a null id is in fold -1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(-1))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned without the held-out fold."""
    from tessera.io import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    found = predict(docs, train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "accepted")

"""BPE encoding and decoding as streaming transducers.

``Vocabulary`` reads a tokenizer file (path is a parameter; other normalizers, pre-tokenizers or decoders than those
it knows are refused) and computes the sufficient lookahead of its merge list: how many symbols to the right can still
change a token. ``Encoder`` takes text in pieces of any size and gives tokens once they are stable. What follows the
last blank waits; when it grows beyond LIMIT characters it is released without a blank: cut before a character that
cannot join the one before it, normalised, split into words, and a word that is still open goes through ``LongWord``,
which keeps a window of symbols. So the state is bounded (by LIMIT, a window and the piece given), whatever the text;
the one exception is a run of combining marks, whose canonical order no cut can keep. ``Decoder`` turns ids back: bytes pass through an incremental UTF-8
state machine, so that characters split over tokens come out once whole.

The lookahead rests on this: merges run in order of rank, so a token boundary depends on text to its right
only by a chain of merges of falling rank, each taking a piece from the right side of the next. The longest
such chain, in symbols, is found by one pass over the merges in order of rank. Each junction between
windows is checked besides: a sequence is the encoding of its text if every neighbouring pair of tokens
encodes to itself; a junction that fails would raise an error instead of giving wrong tokens.

Defined cases: null and empty texts have no tokens; special tokens inside a text are matched as the
library does; texts of any length are encoded whole; null and repeated ids keep their rows; other columns are not
read; an empty table gives no rows; null ids arrays decode to null.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words kept with their tokens by a worker, longest word of the fast path, characters of text taken at a time.
CACHE, SHORT, PIECE = 300_000, 256, 1 << 16
#: Characters without a blank that wait, and those at the end of a cut that stay for what may follow.
LIMIT, TAIL = 1 << 13, 64
_SPACE = r"\t-\r \x85\xa0  -     　"


def _byte_letters() -> dict[int, str]:
    """Byte to its printable stand-in: visible Latin-1 letters as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


class Vocabulary:
    """Merge list, byte alphabet and pre-tokenizer of a tokenizer file with word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or parts != ["Split", "ByteLevel"] or spec["decoder"] or spec["post_processor"] or model["type"] != "BPE":
            raise ValueError(f"{path}: this encoder knows NFC, single spaces, lower case, a split pattern and bytes, and no decoder section")
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = dict((i, t) for t, i in (self.ids | self.special).items())
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault((self.ids[a], self.ids[b]), (r, self.ids[a + b]))
        self.inner = {b: self.ids[c] for b, c in self.letters.items()}
        self.final = {b: self.ids[c + self.end] for b, c in self.letters.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", _SPACE) if r"[^\s" in pattern else pattern)
        self.white = regex.compile(f"[{_SPACE.replace(' ', '', 1)}][{_SPACE}]*| [{_SPACE}]+")  # all but single blanks
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.signs = regex.compile(rf"[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.lookahead = sufficient_lookahead(pairs, self.end)

    def symbols(self, data: bytes, last: bool) -> list[int]:
        """Ids of single bytes; the last one of a word carries its end."""
        out = [self.inner[b] for b in data]
        if last and data:
            out[-1] = self.final[data[-1]]
        return out

    @functools.lru_cache(maxsize=100_000)  # noqa: B019  one vocabulary for each worker
    def parts(self, token: int) -> tuple[int, ...]:
        """The symbols of a token."""
        text, end = self.words[token], self.end
        last = bool(end) and text.endswith(end)
        return tuple(self.symbols(bytes(self.bytes[c] for c in (text[: -len(end)] if last else text)), last))

    def normalize(self, text: str) -> str:
        """NFC, single spaces, lower case by character (so without the final form of sigma)."""
        return self.white.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


def sufficient_lookahead(merges: list, end: str = "") -> int:
    """Symbols to the right of a boundary that can still move it: the longest chain of merges of falling rank."""
    size = lambda t: len(t) - (len(end) if end and t.endswith(end) else 0)
    halves: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}  # token: the longest chain that starts with a merge whose left part it is
    longest = 1
    for a, b in merges:
        most, t = 0, b
        while t:  # b and the pieces at its right end, which an earlier merge could have taken
            most = max(most, reach.get(t, 0))
            t = halves[t][1] if t in halves else ""
        chain = size(b) + most
        reach[a] = max(reach.get(a, 0), chain)
        halves.setdefault(a + b, (a, b))
        longest = max(longest, chain)
    return longest + max((size(a + b) for a, b in merges), default=1)


#: Stands for the merge of a pair that has none.
_NEVER = (1 << 60, -1)


def merge_all(symbols: list[int], rank: dict) -> list[int]:
    """All merges in order of rank, leftmost first."""
    if len(symbols) <= 24:
        out, get = list(symbols), rank.get
        found = [get(p, _NEVER) for p in zip(out, out[1:], strict=False)]
        while found and (best := min(found)) is not _NEVER:
            i = found.index(best)
            out[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((out[i - 1], out[i]), _NEVER)
            if i < len(found):
                found[i] = get((out[i], out[i + 1]), _NEVER)
        return out
    token, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
    heapq.heapify(heap)
    n = len(symbols)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if token[i] == a else n
        if j >= n or token[j] != b:
            continue
        token[i], token[j], after[i] = rank[a, b][1], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (p := (token[left], token[right])) in rank:
                heapq.heappush(heap, (rank[p][0], left, *p))
    return [t for t in token if t >= 0]


_LETTERS = regex.compile(r"\p{L}+")


class LongWord:
    """Tokens of one word through a window: only those further than the lookahead from its end go out."""

    def __init__(self, vocabulary: Vocabulary, window: int):
        self.v, self.window = vocabulary, window
        self.buffer: list[int] = []  # symbols whose tokens are open
        self.byte = b""  # the last byte, which takes the word end if nothing follows
        self.before: int | None = None

    def feed(self, text: str, out: list[int]) -> None:
        data = text.encode()
        for at in range(0, len(data), self.window):
            part = self.byte + data[at : at + self.window]
            self.byte = part[-1:]
            self.buffer += self.v.symbols(part[:-1], False)
            if len(self.buffer) >= self.window:
                tokens = self._merged()
                used = 0
                for t in tokens:
                    size = len(self.v.parts(t))
                    if used + size > len(self.buffer) - self.v.lookahead:
                        break
                    used += size
                    out.append(t)
                    self.before = t
                self.buffer = self.buffer[used:]

    def finish(self) -> list[int]:
        self.buffer += self.v.symbols(self.byte, True)
        return self._merged()

    def _merged(self) -> list[int]:
        tokens = merge_all(self.buffer, self.v.rank)
        if self.before is not None and tokens:
            both = [self.before, tokens[0]]
            if merge_all([*self.v.parts(both[0]), *self.v.parts(both[1])], self.v.rank) != both:
                raise RuntimeError("the lookahead of the merge list is not sufficient")
        return tokens


class _Stems(dict):
    """Normalised word to its tokens; emptied when large, words above SHORT are not kept."""

    def __init__(self, vocabulary: Vocabulary, window: int):
        self.v, self.window = vocabulary, window

    def __missing__(self, word: str) -> list[int]:
        if len(word) > SHORT:
            out: list[int] = []
            long = LongWord(self.v, self.window)
            long.feed(word, out)
            return out + long.finish()
        if len(self) >= CACHE:
            self.clear()
        self[word] = tokens = merge_all(self.v.symbols(word.encode(), True), self.v.rank)
        return tokens


class Encoder:
    """Text pieces in, stable tokens out."""

    def __init__(self, vocabulary: Vocabulary, window: int | None = None, limit: int = LIMIT):
        self.v = vocabulary
        self.window = max(window or 4096, 2 * vocabulary.lookahead)
        self.limit = limit
        self.stems = _Stems(vocabulary, self.window)
        self.rest = ""  # text as given
        self.open, self.norm = False, ""  # a run without blanks is being released; its normalised text that may still change
        self.long: LongWord | None = None
        self.kind = _LETTERS  # what continues the long word

    def held(self) -> int:
        """Characters and symbols of the state."""
        return len(self.rest) + len(self.norm) + (len(self.long.buffer) if self.long else 0)

    def feed(self, piece: str) -> list[int]:
        """Tokens that no later text can change."""
        out: list[int] = []
        self.rest += piece
        if self.open:
            at = min((i for i in (self.rest.find(" "), self.rest.find("\n")) if i >= 0), default=-1)
            if at < 0:
                self._release(out)
                return out
            head, self.rest = self.rest[:at], self.rest[at:]
            self._run(head, out, True)
        cut = max(self.rest.rfind(" "), self.rest.rfind("\n"))
        if cut >= 0:
            out += self._encode(self.rest[:cut])
            self.rest = self.rest[cut:]
        if len(self.rest) > self.limit:
            self._release(out)
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        ready, self.rest = self.rest, ""
        if self.open:
            self._run(ready, out, True)
            return out
        return self._encode(ready)

    def encode(self, text: str) -> list[int]:
        return [t for part in self.stream(text) for t in part]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Tokens of a whole text, some at a time."""
        for at in range(0, len(text), PIECE):
            yield self.feed(text[at : at + PIECE])
        yield self.finish()

    def _release(self, out: list[int]) -> None:
        """Gives on what no blank has ended yet, up to a cut that neither normalisation nor a special token spans."""
        text = self.rest
        for at in range(len(text) - TAIL, 0, -1):
            c = text[at]
            joins = unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff"
            if joins or any(m.start() + max(0, at - TAIL) < at < m.end() + max(0, at - TAIL) for m in self.v.marks.finditer(text[max(0, at - TAIL) : at + TAIL])):
                continue
            self.open, self.rest = True, text[at:]
            self._run(text[:at], out, False)
            return

    def _run(self, text: str, out: list[int], last: bool) -> None:
        at = 0
        for mark in self.v.marks.finditer(text):
            self._open_words(text[at : mark.start()], out, True)
            out.append(self.v.special[mark[0]])
            at = mark.end()
        self._open_words(text[at:], out, last)
        self.open = not last

    def _open_words(self, text: str, out: list[int], last: bool) -> None:
        """Words of a run that goes on, if not ``last``; matches that start in its last characters wait."""
        self.norm += self.v.normalize(text)
        if self.long:
            found = self.kind.match(self.norm)
            end = found.end() if found else 0
            self.long.feed(self.norm[:end], out)
            self.norm = self.norm[end:]
            if not self.norm and not last:
                return
            out += self.long.finish()
            self.long = None
        words = list(self.v.pattern.finditer(self.norm))
        keep = len(self.norm)
        while not last and words and (words[-1].end() == len(self.norm) or words[-1].start() > len(self.norm) - 4):
            keep = words.pop().start()
        for w in words:
            out += self.stems[w[0]]
        self.norm = "" if last else self.norm[keep:]
        if len(self.norm) > SHORT and (found := self.v.pattern.match(self.norm)) and found.end() == len(self.norm):
            self.kind = _LETTERS if _LETTERS.match(self.norm) else self.v.signs
            self.long = LongWord(self.v, self.window)
            self.long.feed(self.norm, out)
            self.norm = ""

    def _encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for mark in self.v.marks.finditer(text):
            self._plain(text[at : mark.start()], out)
            out.append(self.v.special[mark[0]])
            at = mark.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        """Words of a text that ends at a blank are normalised and split together; no word, mark or composed character spans a blank."""
        out.extend(chain.from_iterable(map(self.stems.__getitem__, self.v.pattern.findall(self.v.normalize(text)))))


class Decoder:
    """Ids to text. ``surface`` joins token strings by spaces (a file without a decoder section asks for
    that); ``text`` gives bytes back through a UTF-8 state machine, a space after each word end."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def surface(self, ids: list[int]) -> str:
        return " ".join(map(self.v.words.__getitem__, ids))

    def feed(self, token: int) -> str:
        """The characters that are complete with this token."""
        word, end = self.v.words[token], self.v.end
        if token in self.v.special.values():
            return self.machine.decode(b"", True) + word
        last = bool(end) and word.endswith(end)
        data = bytes(self.v.bytes[c] for c in (word[: -len(end)] if last else word))
        return self.machine.decode(data + b" " * last)

    def text(self, ids: list[int]) -> str:
        self.machine.reset()
        return "".join(map(self.feed, ids)) + self.machine.decode(b"", True)


@functools.lru_cache(maxsize=2)
def worker_encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(Vocabulary(path))


def encode_column(text: Column, path: str) -> Column:
    """Array of token ids."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        encoder = worker_encoder(path)
        return texts.map(lambda t: encoder.encode(t or ""))

    return run(text)


def decode_column(ids: Column, path: str, surface: bool = False) -> Column:
    """Text of token ids: natural text, or the token strings joined by spaces."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        decoder = Decoder(worker_encoder(path).v)
        return rows.map(lambda x: None if x is None else (decoder.surface if surface else decoder.text)([int(i) for i in x]))

    return run(ids)


def token_digests(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again inside the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(path)
        decoder = Decoder(encoder.v)
        number = {i: str(i) for i in encoder.v.words}
        for b in batches:
            rows = []
            for t in b["text_"]:
                n, shown, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.stream(t or ""):  # some tokens at a time, so that no list grows with the text
                    if ids:
                        gap = " " if n else ""
                        shown.update((gap + " ".join(map(number.__getitem__, ids))).encode())
                        decoded.update((gap + decoder.surface(ids)).encode())
                        n += len(ids)
                rows.append((n, shown.hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(**{id_col: b[id_col].values})[[id_col, "n_tokens", "ids_sha256", "decoded_sha256"]]

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text).alias("text_")).mapInPandas(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_codec(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded."""
    from tessera.io import table

    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path or default_path())

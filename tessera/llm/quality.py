"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is labelled good or bad from its own features and those of its neighbours; the forward-backward
marginals of all lines, weighted by length, give the document's share of good text, which a two-parameter
logistic curve turns into a probability.

The weights maximise one objective: the penalised conditional log-likelihood of the training chains, in which every
line has its document's label and both labels weigh the same (``objective`` gives value and gradient).

Bounds of training (parameters): ``sample_rows`` labelled documents, picked by a hash of the id, and ``sample_lines``
lines of each, in chains of CHAIN lines spread evenly over the text; so at most sample_rows * sample_lines rows of
features come to the driver. Scoring reads whole texts.

Defined cases: a null or empty text is one empty line and is scored like any other; without labelled
rows of both kinds the score is the share of label 1 (0.5 if there are none); null and repeated ids keep their rows
(labels of a null id are not used, a repeated id is learned with each of its texts); other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.language import fold

SAMPLE_ROWS, SAMPLE_LINES, CHAIN, STEPS = 2000, 128, 32, 80
#: Penalties on the squares of feature weights and of jump weights.
PENALTY, JUMP_PENALTY = 1e-3, 1e-2
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_MARK, _ODD = b".,;:?", b"#$%&*|<>{}[]\\/=+^~@_!"
#: Own features, and those of them that are also taken from the line before and the line after.
OWN, SHARED = 13, (2, 3, 4, 5, 6, 11, 12)
WIDTH = OWN + 2 * len(SHARED)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Matrix (lines, WIDTH) and the lengths of the lines."""
    lines = text.split("\n")
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    own = []
    for x in lines:
        data, words = x.encode(), x.split()
        n, w = len(data), len(words)
        count = lambda kind, data=data, n=n: n - len(data.translate(None, kind))
        upper, lower = count(_UPPER), count(_LOWER)
        own.append((
            1.0, math.log1p(n) / 8, upper / (upper + lower + 1), min(count(_ODD) / (w + 1), 2.0), min(data.count(b"|") / (w + 1), 1.0),
            1 - len(set(words)) / w if w else 0.0, sum(map(eq, words, words[1:])) / w if w else 0.0, count(_DIGIT) / (n + 1), min(n / (w + 1), 30) / 10,
            float(w < 4), count(_MARK) / (w + 1), min(math.log(seen[x]), 3.0) if w else 0.0, min(data.count(b"!") / (w + 1), 1.0),
        ))
    own = np.array(own)
    near = own[:, SHARED]
    edge = np.zeros((1, len(SHARED)))
    return np.hstack([own, np.vstack([edge, near[:-1]]), np.vstack([near[1:], edge])]), np.array([len(x) + 1.0 for x in lines])


def _chains(x: np.ndarray, lengths: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of many padded chains: P(good) of each line, expected jumps of each chain, log normaliser.

    x: (chains, lines) score of the good state; jump: (2, 2) scores of neighbouring states.
    """
    n, t = x.shape
    alive = np.arange(t) < lengths[:, None]
    emit = np.stack([np.zeros_like(x), np.where(alive, x, 0)], axis=2)
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    add = lambda m, axis: np.logaddexp(*np.moveaxis(m, axis, 0))
    alpha[:, 0] = emit[:, 0]
    for i in range(1, t):
        a = add(alpha[:, i - 1, :, None] + jump, 1) + emit[:, i]
        alpha[:, i] = np.where(alive[:, i, None], a, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        b = add((emit[:, i + 1] + beta[:, i + 1])[:, None, :] + jump, 2)
        beta[:, i] = np.where(alive[:, i + 1, None], b, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * alive
    pair = alpha[:, :-1, :, None] + jump + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    jumps = (np.exp(pair) * alive[:, 1:, None, None]).sum(axis=1)
    return good, jumps, z


class Chains:
    """Padded chains of the training rows, with their labels and weights."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]]):
        parts = [(f[i : i + CHAIN], y) for f, _, y in rows for i in range(0, len(f), CHAIN)]
        self.size = np.array([len(f) for f, _ in parts])
        self.x = np.zeros((len(parts), self.size.max(), WIDTH))
        for k, (f, _) in enumerate(parts):
            self.x[k, : len(f)] = f
        self.y = np.array([y for _, y in parts])
        self.alive = np.arange(self.x.shape[1]) < self.size[:, None]
        rare = 1 / np.bincount([y for *_, y in rows], minlength=2)
        weight = rare[self.y] / self.size  # both labels count the same, and every chain does
        self.weight = weight / weight.sum()

    def objective(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised conditional log-likelihood and its gradient at (feature weights, jump weights)."""
        w, jump = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        score = self.x @ w
        good, jumps, z = _chains(score, self.size, jump)
        same = jump[self.y, self.y]
        path = self.y * (score * self.alive).sum(axis=1) + same * (self.size - 1)
        value = (self.weight * (path - z)).sum() - PENALTY / 2 * (w @ w) - JUMP_PENALTY / 2 * (jump * jump).sum()
        g = np.einsum("ct,ctf->f", (self.alive * self.y[:, None] - good) * self.weight[:, None], self.x) - PENALTY * w
        seen = np.zeros((2, 2))
        np.add.at(seen, (self.y, self.y), self.weight * (self.size - 1))
        return value, np.concatenate([g, (seen - np.einsum("c,cab->ab", self.weight, jumps) - JUMP_PENALTY * jump).ravel()])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> dict:
    """Weights from (features, line lengths, label) of the sample; every line takes its document's label."""
    labels = np.array([y for *_, y in rows])
    if len(set(labels.tolist())) < 2:
        return {"prior": float(labels.mean()) if len(rows) else 0.5}
    chains, theta = Chains(rows), np.zeros(WIDTH + 4)
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, STEPS + 1):  # ascent with adapted steps that shrink
        _, g = chains.objective(theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.3 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    model = {"w": theta[:WIDTH], "jump": theta[WIDTH:].reshape(2, 2)}
    share = np.array([good_share(f, n, model) for f, n, _ in rows])
    a, b, target = 1.0, 0.0, labels.astype(float)
    for _ in range(50):  # Newton steps of the logistic curve
        p = 1 / (1 + np.exp(-(a * share + b)))
        d, h = target - p, p * (1 - p) + 1e-6
        g = np.array([(d * share).sum() - 1e-2 * (a - 1), d.sum()])
        hess = np.array([[(h * share * share).sum() + 1e-2, (h * share).sum()], [(h * share).sum(), h.sum()]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, g), -2, 2)
    return model | {"a": float(a), "b": float(b)}


def marginals(features: np.ndarray, model: dict) -> np.ndarray:
    """P(good) of each line, by forward and backward passes over log odds."""
    s, j = (features @ model["w"]).tolist(), model["jump"]
    (t00, t01), (t10, t11) = np.exp(j).tolist()
    move = lambda r, a, b, c, d: math.log((r * a + b) / (r * c + d))
    forward, r = [], 0.0
    for i, e in enumerate(s):
        r = e if i == 0 else e + move(math.exp(min(max(r, -60), 60)), t11, t01, t10, t00)
        forward.append(r)
    back, r = [0.0] * len(s), 0.0
    for i in range(len(s) - 2, -1, -1):
        r = move(math.exp(min(max(r + s[i + 1], -60), 60)), t11, t10, t01, t00)
        back[i] = r
    return 1 / (1 + np.exp(-np.clip(np.array(forward) + back, -60, 60)))


def good_share(features: np.ndarray, lengths: np.ndarray, model: dict) -> float:
    """Log odds of the length-weighted share of good text."""
    p = float((marginals(features, model) * lengths).sum() / lengths.sum())
    return math.log((p + 1e-4) / (1 - p + 1e-4))


def score_text(text: str, model: dict) -> float:
    if "prior" in model:
        return model["prior"]
    x = model["a"] * good_share(*line_features(text), model) + model["b"]
    return 1 / (1 + math.exp(-min(max(x, -60), 60)))


def sampled_lines(n: int, most: int) -> np.ndarray:
    """Which of n lines are learned: all, or whole chains spread evenly, at most ``most`` lines."""
    if n <= most:
        return np.arange(n)
    chains = max(1, most // CHAIN)
    starts = np.unique(np.linspace(0, n // CHAIN - 1, chains).astype(int)) * CHAIN
    return (starts[:, None] + np.arange(CHAIN)).ravel()


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id", label: str = "quality", text: str = "text") -> dict:
    """A model from at most sample_rows labelled documents and sample_lines lines of each."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("label_"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col, "label_").limit(sample_rows)
    sample = docs.select(id_col, F.coalesce(text, F.lit("")).alias("text_")).join(F.broadcast(chosen), id_col)  # at most sample_rows rows
    mark = F.xxhash64(F.col(id_col).cast("string"), "text_")
    sample = sample.select(mark.alias("mark_"), "label_", "text_").orderBy("mark_", "label_").limit(sample_rows)  # ids may repeat among the documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for t in b["text_"]:
                f, n = line_features(t)
                keep = sampled_lines(len(f), sample_lines)
                got.append((f[keep].astype("<f4").tobytes(), n[keep].astype("<f4").tobytes()))
            yield pd.DataFrame({"mark": b["mark_"], "label": b["label_"], "features": [f for f, _ in got], "lengths": [n for _, n in got]})

    rows = sorted(tuple(r) for r in sample.mapInPandas(run, "mark long, label int, features binary, lengths binary").collect())
    return fit([(np.frombuffer(f, "<f4").astype(float).reshape(-1, WIDTH), np.frombuffer(n, "<f4").astype(float), y) for _, y, f, n in rows])


def score_column(model: dict, text: str = "text") -> Column:
    """Score of a text column, for filters that keep the whole row."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: score_text(t or "", model)).astype(float)

    return run(F.col(text))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row; score is the probability of label 1."""
    return df.select(id_col, score_column(model, text).alias("score"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned without the held-out fold."""
    from tessera.io import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 3) == 1
    model = train(docs, table(spark, sf_dir, "labels").where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

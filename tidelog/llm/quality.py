"""A quality classifier: generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature after another, each tree added to
that feature's lookup table; then on the pairs of features that explain most of
what is left, on coarser two-way tables. A score is a sum of table entries, so a
text is scored by looking up one bin per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .shingles import batches_of

#: The model is fitted on at most so many labelled rows, chosen by a hash of the id.
SAMPLE = 40_000
#: Bins of a feature, bins of each side of a pair, pairs, rounds, leaves and step.
BINS, SIDE, PAIRS, ROUNDS, PAIR_ROUNDS, LEAVES, STEP = 64, 12, 10, 300, 120, 4, 0.08

FEATURES = [
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "non_ascii", "space", "line_end", "sentence_end", "comma", "bang", "bar", "symbol",
    "distinct_words", "repeated_lines", "line_length", "short_words", "ends_in_symbol", "title_words", "upper_words", "entropy", "commonest_word", "words_a_sentence",
]


def _sum(counts: np.ndarray, characters: str) -> float:
    return float(counts[list(characters.encode())].sum())


def text_features(text: str | None) -> list[float]:
    """Numbers about one text, in the order of FEATURES; empty and null texts have zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    share = counts[counts > 0] / n
    sentences = _sum(counts, ".?!")
    return [
        np.log1p(n), np.log1p(w), sum(map(len, words)) / w, float(max(map(len, words))), counts[65:91].sum() / n, counts[48:58].sum() / n, counts[128:].sum() / n,
        _sum(counts, " \t") / n, counts[10] / n, sentences / w, counts[44] / w, counts[33] / w, counts[124] / w, _sum(counts, "#$%&*<>=@^_~{}[]\\/+") / w,
        len(tally) / w, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(len(x) <= 3 for x in words) / w, sum(x[-1:] in b"#$%&*!" for x in words) / w,
        sum(x[:1].isupper() for x in words) / w, sum(x.isupper() for x in words) / w, float(-(share * np.log2(share)).sum()), max(tally.values()) / w, w / (sentences + 1),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; a score is the logistic of their sum."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if self.tables is not None:
            for j, edge in enumerate(self.edges):
                total += self.tables[j, np.searchsorted(edge, x[:, j], side="right")]
            for k, (a, b) in enumerate(self.pairs):
                total += self.pair_tables[k, np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree with at most so many leaves over the bins of one feature, by sums of gradients and curvatures."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for a, b in parts:
            if b - a > 1:
                s = np.arange(a + 1, b)
                gain = _gain(cg[s] - cg[a], ch[s] - ch[a]) + _gain(cg[b] - cg[s], ch[b] - ch[s]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                gain = np.where((ch[s] - ch[a] < 1) | (ch[b] - ch[s] < 1), -1.0, gain)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), (a, b), int(s[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        a, b = best[1]
        parts = [p for p in parts if p != (a, b)] + [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _tree_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree over a two-way table: one cut of the first side, one cut of the second in each half."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for s in range(1, len(a)):
            halves = [(slice(0, s), a[:s].sum(0), b[:s].sum(0)), (slice(s, None), a[s:].sum(0), b[s:].sum(0))]
            made, total = np.zeros_like(a), 0.0
            for rows, x, y in halves:
                values = _tree(x, y, 2)
                made[rows] = values
                total += float((values * x).sum())
            if total > best:
                best, out = total, made.T if flip else made
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting, first of the features, then of the pairs; without both labels a model that says the share of label 1 (a half with none)."""
    model = Model()
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        model.start = float(np.log(share / (1 - share)))
        return model
    model.start = float(np.log(y.mean() / (1 - y.mean())))
    model.edges, model.coarse = [_edges(v, BINS) for v in x.T], [_edges(v, SIDE) for v in x.T]
    bins = [np.searchsorted(e, v, side="right") for e, v in zip(model.edges, x.T, strict=True)]
    wide = [np.searchsorted(e, v, side="right") for e, v in zip(model.coarse, x.T, strict=True)]
    model.tables = np.zeros((len(bins), BINS + 1))
    total = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            value = STEP * _tree(np.bincount(b, y - p, BINS + 1), np.bincount(b, p * (1 - p), BINS + 1), LEAVES)
            model.tables[j] += value
            total += value[b]
    p = 1 / (1 + np.exp(-total))
    gains = []
    for i in range(len(wide)):
        for j in range(i):
            at = wide[i] * SIDE + wide[j]
            g, h = np.bincount(at, y - p, SIDE * SIDE), np.bincount(at, p * (1 - p), SIDE * SIDE)
            gains.append((float(_gain(g, h).sum()), (i, j)))
    model.pairs = [pair for _, pair in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), SIDE, SIDE))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            at = wide[i] * SIDE + wide[j]
            g, h = np.bincount(at, y - p, SIDE * SIDE).reshape(SIDE, SIDE), np.bincount(at, p * (1 - p), SIDE * SIDE).reshape(SIDE, SIDE)
            value = STEP * _tree_pair(g, h)
            model.pair_tables[k] += value
            total += value.reshape(-1)[at]
    return model


def _features(docs: DataFrame, rest: list[str], text: str) -> DataFrame:
    schema = docs.select(*rest, F.array(F.lit(0.0)).alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, text):
                x = [text_features(t) for t in part[text].to_pylist()]
                yield pa.RecordBatch.from_arrays([part[c] for c in rest] + [pa.array(x, pa.list_(pa.field("element", pa.float64(), False)))], schema=None, names=[*rest, "x"])

    return docs.select(*rest, text).mapInArrow(tidy(run), schema)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the label (0 or 1), from at most ``sample`` of the labelled rows; rows with a null label or id aren't used, a repeated id counts once. Empty tables give a model that says a half."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id")
    found = _features(rows.select("id", "y", "t"), ["id", "y"], "t").toPandas().sort_values("id", kind="stable")
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy(np.float64))


def score_texts(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Adds score (0 to 1) to the rows of docs, replacing a column of that name; null and empty texts have a score too, repeated rows stay, and an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in texts:
            x = np.array([text_features(t.as_py()) for t in each], np.float64).reshape(len(each), len(FEATURES))
            yield pa.array(shared.value.score(x), pa.float64())

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:  # only texts go to Python, one at a time, and only scores come back
        yield from tidy(scores)(texts)

    return docs.select(*[c for c in docs.columns if c != score]).withColumn(score, F.arrow_udf(run, "double")(F.col(text)))

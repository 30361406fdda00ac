"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into at most BINS quantile bins. Boosting goes round the features in turn, fits a
shallow tree to one feature's bins at a time and adds its leaves to that feature's table; then the pairs of features
with the largest gain get tables of their own in the same way. The model is these tables, so a
document's score is a sum of table entries, looked up for a whole batch at once. It is trained on at
most MAX_LABELLED labelled rows, the first in the order of a hash; of documents with one id, the row with the least features counts.

Defined results: a null text is scored as an empty one; each row is scored by itself, repeated rows alike; labels that are null, or belong to no
document, don't count; without labels of both kinds the score is the share of label 1, smoothed (0.5 without labels); a null doc_id counts
as '' for the fold; an empty table gives an empty result; further columns are ignored by `score`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw_texts, table
from .shingles import SPACE

MAX_LABELLED = 20_000
BINS = 32
COARSE = 8
PAIRS = 6
ROUNDS = 60
RATE = 0.15
FOLDS, HELD_OUT = 3, 1

#: Byte classes, each a feature: its share of the text.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "pipe": b"|/\\_~<>{}[]",
    "symbol": b"#$%&*+=@^",
    "quote": b"\"'`()-",
    "high": bytes(range(128, 256)),
}
NAMES = (*CLASSES, "length", "words", "word_length", "word_spread", "distinct", "top", "next", "lines", "line_length", "repeated_lines", "ended_lines", "capital_words", "one_letter", "packed")

_CLASS = np.zeros((256, len(CLASSES)))
for _k, _c in enumerate(CLASSES.values()):
    _CLASS[np.frombuffer(_c, dtype=np.uint8), _k] = 1


_packers: list[zstandard.ZstdCompressor] = []


def _packer() -> zstandard.ZstdCompressor:
    """One per Python worker."""
    if not _packers:
        _packers.append(zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False))
    return _packers[0]


def features(text: bytes) -> list[float]:
    """Of a whole text; in the order of NAMES."""
    n, data = len(text), np.frombuffer(text, dtype=np.uint8)
    shares = (np.bincount(data, minlength=256) @ _CLASS / max(n, 1)).tolist()
    words = text.split()
    w = max(len(words), 1)
    gap = np.ones(n + 2, dtype=bool)
    gap[1:-1] = SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    first = data[starts]
    counts = Counter(words)
    top = [c for _, c in counts.most_common(2)] if len(counts) < 64 else sorted(counts.values())[:-3:-1]
    lines = [x for x in text.split(b"\n") if x]
    m = max(len(lines), 1)
    return [
        *shares,
        math.log1p(n),
        math.log1p(len(words)),
        float(sizes.mean()) if words else 0.0,
        float(sizes.std()) if words else 0.0,
        len(counts) / w,
        (top[0] if top else 0) / w,
        (top[1] if len(top) > 1 else 0) / w,
        math.log1p(len(lines)),
        math.log1p(n / m),
        1 - len(set(lines)) / m,
        sum(x[-1] in b".!?" for x in lines) / m,
        int(np.count_nonzero((first >= 65) & (first <= 90))) / w,
        int(np.count_nonzero(sizes == 1)) / w,
        len(_packer().compress(text)) / max(n, 1),
    ]


def matrix(texts: Iterator[bytes | None]) -> np.ndarray:
    rows = [features(t or b"") for t in texts]
    return np.array(rows, dtype=float).reshape(len(rows), len(NAMES))


class AdditiveModel:
    """cuts[f]: a feature's bin edges; tables[f]: a value a bin; pairs[(f, g)]: (edges of f, edges of g, values[bin of f, bin of g])."""

    def __init__(self, bias: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: dict):
        self.bias, self.cuts, self.tables, self.pairs = bias, cuts, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(c, x[:, f], side="right")]
        for (f, g), (c, d, t) in self.pairs.items():
            z += t[np.searchsorted(c, x[:, f], side="right"), np.searchsorted(d, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 1) / (len(y) + 2)
        bias = math.log(share / (1 - share))
        edges = lambda v, bins: np.unique(np.quantile(v, np.arange(1, bins) / bins)) if len(v) else np.zeros(0)
        cuts = [edges(x[:, f], BINS) for f in range(len(NAMES))]
        tables = [np.zeros(len(c) + 1) for c in cuts]
        if not len(y) or y.min() == y.max():
            return cls(bias, cuts, tables, {})
        at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
        z = np.full(len(y), bias)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(ROUNDS):
            for f, t in enumerate(tables):
                g, h = slopes()
                step = RATE * shallow(np.bincount(at[f], g, len(t)), np.bincount(at[f], h, len(t)), 2)
                t += step
                z += step[at[f]]
        # Pairs: coarse bins, ranked by what one tree of each would gain on the residuals.
        rough = [edges(x[:, f], COARSE) for f in range(len(NAMES))]
        low = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(rough)]
        g, h = slopes()
        gains = {}
        for f in range(len(NAMES)):
            for k in range(f):
                shape = (len(rough[k]) + 1, len(rough[f]) + 1)
                cell = low[k] * shape[1] + low[f]
                gs, hs = np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)
                gains[k, f] = float((gs * quarters(gs, hs)).sum())
        chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
        pairs = {p: (rough[p[0]], rough[p[1]], np.zeros((len(rough[p[0]]) + 1, len(rough[p[1]]) + 1))) for p in chosen}
        for _ in range(ROUNDS // 2):
            for (k, f), (_, _, t) in pairs.items():
                g, h = slopes()
                cell = low[k] * t.shape[1] + low[f]
                step = RATE * quarters(np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape))
                t += step
                z += step.ravel()[cell]
        return cls(bias, cuts, tables, pairs)


def leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, the first bin on the right) of the best cut of a row of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree of that depth over one feature's bins: its leaf for each bin."""
    gain, cut = best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), leaf(g.sum(), h.sum()))
    return np.r_[shallow(g[:cut], h[:cut], depth - 1), shallow(g[cut:], h[cut:], depth - 1)]


def quarters(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over two features' bins: a cut of one, then one of the other in each half, whichever order gains more."""
    found = []
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, cut = best_cut(a.sum(1), b.sum(1))
        out = np.zeros(a.shape)
        for part in (slice(0, cut), slice(cut, len(a))):
            if out[part].size:
                out[part] = shallow(a[part].sum(0), b[part].sum(0), 1)[None, :]
        out = out.T if flip else out
        found.append((float((out * g).sum()), out))
    return max(found, key=lambda x: x[0])[1]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> AdditiveModel:
    """From the documents that labels.quality marks 0 or 1, without those of the held-out fold."""
    marked = labels.select(F.col("doc_id").alias("_d"), "quality").where(F.col("quality").isin(0, 1) & F.col("_d").isNotNull() & (fold(F.col("_d")) != HELD_OUT))
    marked = marked.orderBy(F.xxhash64("_d"), "_d", "quality").limit(most)
    # `most` rows of two numbers at most.
    known = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("_d")).select("_d", "quality", "text")
    width = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(raw_texts(b["text"]))
            yield pa.RecordBatch.from_arrays([b["_d"].cast(pa.int64()), b["quality"].cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], names=["d", "y", "x"])

    # One row of each label, also where documents repeat: `most` at most.
    rows = known.mapInArrow(run, "d long, y int, x array<double>").groupBy("d", "y").agg(F.min("x").alias("x")).toArrow().combine_chunks()
    if not len(rows):
        return AdditiveModel.fit(np.zeros((0, width)), np.zeros(0))
    x, y, d = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, width), rows["y"].to_numpy().astype(float), rows["d"].to_numpy()
    order = np.lexsort((*x.T, y, d))
    return AdditiveModel.fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    names = ["doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.score(matrix(raw_texts(b["text"]))))], names=names)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of docs with a score of at least 0.5, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(matrix(raw_texts(b["text"]))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))

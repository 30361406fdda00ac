"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

A rule `host/path` fits its host and every subdomain when the url's path starts with the rule's path; the
longest fitting rule decides. Urls that no rule fits get the verdict of a logistic regression whose
features are the hashed character 3- to 5-grams of host and path. The model is trained from a small
labelled table of urls: the caller's, or urls that the rules themselves label (`labelled_by_rules`).

Defined results: a null url, or one without `://`, has an empty host and an empty path, and the model judges
it as it would any text; repeated rows are judged one by one; an empty training table, or one with a single
label, gives a model that returns the share of label 1 (0, allow, without rows); an empty input gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, raw_texts, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the production filter: rule (host, then path) and verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Rows of the labelled url table at most.
MAX_LABELLED = 8192
#: Hashed features.
DIMENSIONS = 1 << 16
GRAMS = (3, 4, 5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def gram_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram of every text, vectorised over the whole batch."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), lengths)
    rows, features = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            code = code * np.uint64(0x100000001B3) + data[i : len(data) - n + 1 + i]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        inside = row[: len(code)] == row[n - 1 :]
        rows.append(row[: len(code)][inside])
        features.append((code[inside] >> np.uint64(40)).astype(np.int64) % DIMENSIONS)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(features)


def framed(hosts: list[bytes], paths: list[bytes]) -> list[bytes]:
    """Host and path with marks at their ends, so that n-grams know where they stand."""
    return [b"^" + h + b"$ " + p + b"|" for h, p in zip(hosts, paths, strict=True)]


class UrlModel:
    """Weights of the hashed n-grams and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        row, feature = gram_features(texts)
        count = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        z = np.bincount(row, weights=self.weights[feature], minlength=len(texts)) / np.sqrt(count) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], steps: int = 120, rate: float = 0.5, decay: float = 1e-4) -> UrlModel:
        """Full-batch gradient descent with momentum; the same table gives the same model."""
        y = np.asarray(labels, dtype=float)
        if not len(y):
            return cls(np.zeros(DIMENSIONS), -1.0)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        w, bias = np.zeros(DIMENSIONS), float(np.log(share / (1 - share)))
        if y.min() == y.max():
            return cls(w, bias)
        row, feature = gram_features(texts)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
        moved, moved_bias, value = np.zeros(DIMENSIONS), 0.0, scale[row]
        for _ in range(steps):
            z = np.bincount(row, weights=w[feature] * value, minlength=len(y)) + bias
            off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
            moved = 0.9 * moved + np.bincount(feature, weights=off[row] * value, minlength=DIMENSIONS) + decay * w
            moved_bias = 0.9 * moved_bias + off.sum()
            w, bias = w - rate * 10 * moved, bias - rate * moved_bias
        return cls(w, bias)


def labelled_by_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, most: int = MAX_LABELLED) -> DataFrame:
    """(url, label) of at most `most` different urls that a rule decides, label 1 for block: those that come first in the order of a hash."""
    host, path = host_and_path(F.col("url"))
    _, verdict = rule_for(host, path, rules)
    known = pages.select("url", verdict.alias("verdict")).where(F.col("verdict").isNotNull()).distinct()
    return known.orderBy(F.xxhash64("url"), "url").limit(most).select("url", (F.col("verdict") == "block").cast("int").alias("label"))


def train(labelled: DataFrame, most: int = MAX_LABELLED) -> UrlModel:
    """From a small table of (url, label 0 or 1), its first `most` rows in the order of a hash; label 1 is block. Rows with a null label don't count."""
    host, path = host_and_path(F.col("url"))
    known = labelled.where(F.col("label").isNotNull()).orderBy(F.xxhash64("url"), "url", "label").limit(most)
    rows = known.select(host.alias("h"), path.alias("p"), "label").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("p", "ascending"), ("label", "ascending")])
    return UrlModel.fit(framed(list(raw_texts(rows["h"])), list(raw_texts(rows["p"]))), rows["label"].to_pylist())


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's chance of block) of every url."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"))
    weights, bias = model.weights.astype(np.float32), model.bias
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UrlModel(weights, bias)
        for b in batches:
            p = model.score(framed(list(raw_texts(b["host"])), list(raw_texts(b["path"]))))
            own = pa.array(np.where(p >= 0.5, "block", "allow").tolist(), type=pa.string())
            yield batch(schema, b["page_id"], b["host"], b["path"], b["rule"], pa.compute.coalesce(b["given"], own), p)

    return parts.mapInArrow(score, "page_id long, host string, path string, rule string, verdict string, score double")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_by_rules(pages)))

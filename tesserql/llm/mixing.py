"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by a hash into at most BLOCKS blocks; a keyed hash permutes the blocks. A source
whose target is r times its size gives floor(r) whole passes over its blocks and, in one more pass, the permuted
blocks up to the rest; the block on the edge is cut between documents, in the order of their hash. The drawn
blocks of all sources are then dealt to output shards: a binary tree over the shards splits the exact block
quotas at each node by a multivariate hypergeometric draw, first those of BUCKETS groups of sources, then within each group those of its sources, so shards get disjoint
runs of each source's permuted blocks. Within a shard, rows are ordered by another hash.

The plan has one row a source and block. Documents find their blocks, passes and shards in it, so a text moves once, to its shard (twice where the plan is too large to be
broadcast). What reaches the driver: sums over sources, and BUCKETS counts for the tree, whose numbers of blocks may add up to 10^9 (over a million sources). Reruns give the same.

Defined results: a null text has size 0 and counts as an empty one, null sources form one source, the last one; a document of size 0 is
taken as its block is; a source of size 0 has target 0 and takes nothing; no row is taken more than MOST_REPEATS times; rows equal in id, text and source
are drawn alike, each as often as the others; null ids are told apart by their texts; an empty table gives an empty result; further columns of the input are passed through by `mix`, but for
mix_shard and mix_place, which it replaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, partitions, stage, table, unstage

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCKS = 256
BUCKETS = 1024
SEED = "mix1"
SHARDS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """What knows a document; its first digits choose the block, and it orders the documents of a block."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def block_of(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % BLOCKS


def block_order(source: Column, block: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}-block:"), F.coalesce(source, F.lit("")), F.lit(":"), block.cast("string")))


def targets(blocks: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target of every source of (source, words): its weight's share of all words; none above `most` times its size, the excess goes to the others by weight."""
    sized = blocks.groupBy("source").agg(F.sum("words").alias("words")).withColumn("last", F.col("source").isNull())
    ranked = numbered(sized, "number", ["last", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = stage(ranked.select("source", F.col("words").alias("source_size"), weight.alias("w"), (F.col("words") * most).alias("cap"), (F.col("words") * most / weight).alias("ratio")), "sources")
    # The level to which sources are filled; it rises as full ones leave, until none does.
    total, level, full = sources.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    while True:
        is_full = F.col("ratio") < level if full is not None else F.lit(False)
        n, capped, free = sources.agg(F.count(F.when(is_full, 1)), F.coalesce(F.sum(F.when(is_full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_full, F.col("w"))), F.lit(0.0))).first()
        if n == full or not free:
            break
        full, level = n, float(total - capped) / free
    return sources.select("source", "source_size", F.when(F.col("ratio") < level, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def split_tree(have: np.ndarray, quotas: np.ndarray, seed: list[int]) -> np.ndarray:
    """have: drawn blocks of each source (or group of sources); quotas: blocks of each shard. Returns blocks[shard, source]: at each node of a binary tree over the shards, one multivariate hypergeometric draw."""
    out = np.zeros((len(quotas), len(have)), dtype=np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([*seed, lo, hi]))
        left = rng.multivariate_hypergeometric(have, int(quotas[lo:mid].sum()), method="marginals") if have.sum() else have
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, len(quotas), np.asarray(have, dtype=np.int64))
    return out


def even(total: int, shards: int) -> np.ndarray:
    """`total` blocks, dealt as evenly as it goes."""
    return np.diff([total * i // shards for i in range(shards + 1)])


def _shards(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """_q, ends of (source, n drawn blocks): the shard i takes the source's drawn blocks from ends[i - 1] up to ends[i]."""
    dealt = drawn.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int"))
    counts = {r["bucket"]: r["n"] for r in dealt.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most BUCKETS
    names = sorted(counts)
    split = split_tree(np.array([counts[b] for b in names], dtype=np.int64), even(sum(counts.values()), shards), [seed])
    quotas = {b: split[:, i] for i, b in enumerate(names)}

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", kind="stable")
        b = int(rows["bucket"].iloc[0])
        own = split_tree(rows["n"].to_numpy(dtype=np.int64), quotas[b], [seed, b + 1])
        return pd.DataFrame({"_q": rows["source"], "ends": list(np.cumsum(own, axis=0).T.tolist())})

    return dealt.groupBy("bucket").applyInPandas(within, "_q string, ends array<long>")


def planned(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, key, block of every row; the plan: a row a source and block, with its passes, whether one more takes it whole or up to the key `upto_key`, and each pass's shard)."""
    key = key_of(F.col("doc_id"), F.col("text"))
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key")).withColumn("block", block_of(F.col("key"))), "sizes")
    blocks = stage(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sources = targets(blocks, weights, most).withColumnRenamed("source", "_q")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    rest = F.when(F.col("passes") < most, F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))).otherwise(0.0)
    plan = blocks.join(sources, F.col("source").eqNullSafe(F.col("_q"))).drop("_q").withColumn("passes", passes).withColumn("rest", rest)
    # At most BLOCKS rows a source.
    order = Window.partitionBy("source").orderBy("o", "block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = plan.withColumn("o", block_order(F.col("source"), F.col("block"))).withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
    plan = plan.withColumn("whole", (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))).withColumn("edge", (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")))
    plan = plan.withColumn("at", F.row_number().over(order) - 1).withColumn("blocks", F.count("*").over(Window.partitionBy("source")))
    plan = plan.withColumn("drawn", F.col("passes") + (F.col("whole") | F.col("edge")).cast("int")).withColumn("room", F.col("rest") - F.col("before"))
    plan = stage(plan.select("source", "block", "source_size", "target", "passes", "whole", "edge", "at", "blocks", "drawn", "room"), "plan")
    unstage(blocks)
    ends = _shards(plan.groupBy("source").agg(F.sum("drawn").cast("long").alias("n")).where("n > 0"), shards, seed)
    # The whole and edge blocks come first in order, so the last pass goes on from the blocks before as the others do.
    shard = F.transform(F.sequence(F.lit(0), F.col("drawn") - 1), lambda p: F.size(F.filter("ends", lambda e: e <= p * F.col("blocks") + F.col("at"))))
    with_shards = plan.join(ends, F.col("source").eqNullSafe(F.col("_q")), "left").withColumn("shards", F.when(F.col("drawn") > 0, shard))
    cut = _cuts(sized, plan.where("edge").select("source", "block", "room")).withColumnRenamed("source", "_q2")
    out = with_shards.drop("_q").join(cut, F.col("edge") & F.col("source").eqNullSafe(F.col("_q2")), "left")
    out = stage(out.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "source_size", "target", "passes", "whole", "edge", "upto_key", "shards"), "plan")
    unstage(plan)
    return sized, out


def _cuts(sized: DataFrame, edges: DataFrame) -> DataFrame:
    """source, upto_key: in its edge block a source takes the documents up to this key, where the words taken come nearest to the room in the block.

    The sums are made in two steps, so that no task sorts the rows of a block: over parts of the block, at most 65,536 by the next digits of the key, then over the documents of the one part that has the edge.
    """
    rows = sized.join(edges.select(F.col("source").alias("_e"), F.col("block").alias("_b"), "room"), F.col("source").eqNullSafe(F.col("_e")) & (F.col("block") == F.col("_b")))
    rows = rows.select("source", "room", "key", "size", F.substring("key", 1, 6).alias("part"))
    upto = lambda by: Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("room").alias("room")).withColumn("upto", F.sum("words").over(upto("part"))).withColumn("before", F.col("upto") - F.col("words"))
    part = parts.where((F.col("before") <= F.col("room")) & (F.col("upto") > F.col("room"))).select(F.col("source").alias("_p"), F.col("part").alias("_r"), "before")
    own = rows.join(part, F.col("source").eqNullSafe(F.col("_p")) & (F.col("part") == F.col("_r"))).groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("room").alias("room"), F.first("before").alias("before"), F.first("part").alias("part"))
    own = own.withColumn("upto", F.col("before") + F.sum("words").over(upto("key")))
    # Without one, a key before all of the part's.
    return own.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("room"), F.col("key"))), F.max("part")).alias("upto_key"))


def _times() -> Column:
    return F.col("passes") + (F.col("whole") | (F.col("edge") & (F.col("key") <= F.col("upto_key")))).cast("int")


def _on(source: Column, block: Column) -> Column:
    return source.eqNullSafe(F.col("_s")) & (block == F.col("_b"))


def draws(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken of every row."""
    rows = sized.join(plan, _on(F.col("source"), F.col("block"))).withColumn("times", _times())
    return rows.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 1) -> DataFrame:
    """docs, each row as often as the mix takes it, with the output shard and the place in it (`mix_shard` int, `mix_place` long: a hash to sort by)."""
    return emit(docs, planned(docs, shards, weights, most, seed)[1], seed)


def emit(docs: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of docs that the plan draws."""
    names = [c for c in docs.columns if c not in ("mix_shard", "mix_place")]
    own = docs.select(F.struct(*names).alias("_d"), F.col("source").cast("string").alias("_o"), key_of(F.col("doc_id"), F.col("text")).alias("key"))
    rows = own.join(plan, _on(F.col("_o"), block_of(F.col("key")))).withColumn("times", _times())
    rows = rows.where("times > 0").select("_d", "_o", "key", F.posexplode(F.slice("shards", F.lit(1), F.col("times"))).alias("pass", "shard"))
    return rows.select("_d.*", F.col("shard").alias("mix_shard"), F.xxhash64(F.lit(seed), "pass", "key", "_o").alias("mix_place"))


def in_order(mixed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix, each shard's rows together and in the order of their places; a shard is cut into as many ranges of places as give the session's partitions, one partition each."""
    per = -(-max(partitions(mixed.sparkSession), shards) // shards)
    # Places are hashes, so ranges of the same width are equally full.
    cut = F.floor((F.shiftright("mix_place", 48) + F.lit(1 << 15)) * F.lit(per) / F.lit(1 << 16))
    return mixed.repartitionById(shards * per, (F.col("mix_shard") * per + cut).cast("int")).sortWithinPartitions("mix_shard", "mix_place")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix emits, counted for each document; what it emits is written with its texts, shard by shard."""
    docs = table(spark, sf_dir, "documents")
    sized, plan = planned(docs)
    emitted = stage(in_order(emit(docs, plan)), "mixed")
    copies = emitted.groupBy(F.col("source").alias("_c"), key_of(F.col("doc_id"), F.col("text")).alias("_k")).agg(F.count("*").alias("copies"))
    rows = sized.groupBy("doc_id", "source", "key", "block", "size").agg(F.count("*").alias("n"))
    rows = rows.join(copies, F.col("source").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")), "left")
    # Equal rows are emitted equally often.
    rows = rows.withColumn("taken", (F.coalesce("copies", F.lit(0)) / F.col("n") * F.col("size")).cast("long")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.join(plan, _on(F.col("source"), F.col("block"))).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('mix1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS words, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * words / w AS ratio, row_number() OVER (ORDER BY 3 * words / w, source NULLS LAST) AS k FROM s),
l AS (
  SELECT *, (sum(words) OVER () - coalesce(sum(3 * words) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
f AS (SELECT min(k) AS k0 FROM l WHERE ratio >= level),
t AS (
  SELECT source, words, CASE WHEN k < k0 THEN (3 * words)::DOUBLE ELSE (SELECT level FROM l WHERE k = (SELECT k0 FROM f)) * w END AS target FROM l, f),
p AS (
  SELECT *, CASE WHEN words > 0 THEN least(floor(target / words), 3) ELSE 0 END::BIGINT AS passes FROM t),
g AS (
  SELECT source, ('0x' || substr(key, 1, 4))::INT % 256 AS block, doc_id, size, key FROM d),
b AS (SELECT source, block, sum(size) AS words FROM g GROUP BY ALL),
c AS (
  SELECT b.source, b.block, p.words AS source_size, p.target, p.passes, CASE WHEN p.passes < 3 THEN greatest(p.target - p.passes * p.words, 0) ELSE 0 END AS rest, b.words,
    sum(b.words) OVER (PARTITION BY b.source ORDER BY md5('mix1-block:' || coalesce(b.source, '') || ':' || b.block), b.block) AS upto
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
e AS (
  SELECT g.doc_id, g.size, c.*, sum(g.size) OVER (PARTITION BY g.source, g.block ORDER BY g.key) AS run, sum(g.size) OVER (PARTITION BY g.source, g.block, g.key) AS own
  FROM g JOIN c ON g.source IS NOT DISTINCT FROM c.source AND g.block = c.block)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (passes + CASE WHEN rest > 0 AND upto <= rest THEN 1
  WHEN upto > rest AND upto - words < rest AND run - own / 2.0 <= rest - (upto - words) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""

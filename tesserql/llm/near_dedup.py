"""Near-duplicate documents by min-max hashing, with every link confirmed on whole shingle sets.

1. One pass over the texts gives each document its set's size and digest, and a key a band of its min-max signature (both the minimum and
   the maximum under each map, so half the evaluations). Documents with equal sets are one node from here on.
2. Keys are range-partitioned with their nodes and sorted; a pass over each partition gives each bucket's members
   with its first node, the hub. A bucket that several partitions share has a hub in each, which are then tied to the first.
3. All members that meet a hub form its group, cut by a hash into blocks of about BLOCK shingles and MEMBERS documents at most. A block is compared with itself on
   whole sets, only between members that links don't connect yet, and reports at most as many links as members.
4. Connected components of these links. Groups of more than one block then compare, across blocks, members outside their group's
   largest component with all members: pairs inside one component need no test. Then components again.

No bucket, group or partner is capped. A pair at the threshold is missed only if no band of it agrees: with 60 bands of 6 values, at a similarity of 0.8,
(1 - 0.8^6)^60, about 1e-8.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a row without doc_id takes part in nothing
(component null, kept); exactly repeated rows have equal sets; rows with one doc_id and different texts are one node, whose links are those of all
of them; an empty table gives an empty result; further columns are ignored by `near_duplicates` and passed through by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import int64s, partitions, raw_texts, stage, table, unstage
from .components import components
from .shingles import MinMax, common, shingle_set

BANDS, ROWS = 60, 6
PERCENT = 80
#: Shingles that a block of a group holds, about (one document may be larger), and documents.
BLOCK = 1 << 18
MEMBERS = 2048
#: Columns of the membership matrix at a time, and documents on either side.
WIDE = 4096
TILE = 1024
#: Parts in which the members of a large group are dealt to their blocks.
SALTS = 64


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = MinMax(bands, rows)
        for b in batches:
            sizes, digests, keys = [], [], []
            for text in raw_texts(b["text"]):
                x = shingle_set(text, width)
                sizes.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                keys.append(maps.keys(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "keys"])

    return run


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node): (hub, node) of each bucket of two or more; of the partition's first and last bucket the hub with its key too, as other partitions may share it."""

    def out(hub, node, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(node, pa.int64()), pa.array(key, pa.int64())], names=["hub", "node", "key"])

    open_key = open_hub = None
    for b in batches:
        if not len(b):
            continue
        key, node = int64s(b["key"]), int64s(b["node"])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        hub = node[starts]
        if open_key is None:
            yield out([hub[0]], [hub[0]], [key[0]])
        elif open_key == key[0]:
            hub[0] = open_hub
        hubs = np.repeat(hub, np.diff(np.r_[starts, len(key)]))
        member = hubs != node
        if member.any():
            yield out(hubs[member], node[member], pa.nulls(int(member.sum()), pa.int64()))
        open_key, open_hub = int(key[-1]), int(hubs[-1])
    if open_key is not None:
        yield out([open_hub], [open_hub], [open_key])


class Forest:
    def __init__(self, roots: list[int]):
        self.up = list(roots)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def compare(left: list[int], right: list[int], sets: list[np.ndarray], forest: Forest, percent: int) -> list[tuple[int, int]]:
    """Pairs (of places in sets) at the threshold that connect what the forest didn't; left and right may share places."""
    found = []
    n = np.array([len(x) for x in sets], dtype=np.int64)
    if len(left) * len(right) <= 400:
        for i in left:
            for j in right:
                if i != j and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]) and forest.find(i) != forest.find(j):
                    both = common(sets[i], sets[j])
                    if 100 * both >= percent * (n[i] + n[j] - both) and forest.join(i, j):
                        found.append((i, j))
        return found
    # By size, so that a tile meets only tiles of sizes that can be near.
    left, right = sorted(left, key=n.__getitem__), sorted(right, key=n.__getitem__)
    for x in (left[at : at + TILE] for at in range(0, len(left), TILE)):
        for y in (right[at : at + TILE] for at in range(0, len(right), TILE)):
            if 100 * n[x[-1]] < percent * n[y[0]] or 100 * n[y[-1]] < percent * n[x[0]] or len({forest.find(i) for i in (*x, *y)}) == 1:
                continue
            many = shared_counts(x, y, sets, n)
            near = 100 * many >= percent * (n[x][:, None] + n[y][None, :] - many)
            root = np.array([forest.find(j) for j in y])
            for at in np.flatnonzero(near.any(axis=1)).tolist():
                # One of each component that the row's document is near to.
                js = np.flatnonzero(near[at])
                for j in js[np.unique(root[js], return_index=True)[1]].tolist():
                    own, other = forest.find(x[at]), forest.find(y[j])
                    if own != other:
                        forest.join(own, other)
                        found.append((x[at], y[j]))
                        root[(root == own) | (root == other)] = min(own, other)
    return found


def shared_counts(left: list[int], right: list[int], sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """How many members the sets of each pair share, by products of membership matrices over the shared values."""
    a, b = np.concatenate([sets[i] for i in left]), np.concatenate([sets[j] for j in right])
    shared = np.unique(a)
    shared = shared[np.isin(shared, b, kind="sort")]
    if left == right:  # only what two hold
        values, counts = np.unique(a, return_counts=True)
        shared = values[counts > 1]

    def places(values: np.ndarray, who: list[int]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(who)), n[who])
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        there = shared[at] == values if len(shared) else np.zeros(len(values), dtype=bool)
        return row[there], at[there]

    (ra, ca), (rb, cb) = places(a, left), places(b, right)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(shared), WIDE):
        wide = min(WIDE, len(shared) - at)
        x, y = np.zeros((len(left), wide), dtype=np.float32), np.zeros((len(right), wide), dtype=np.float32)
        ka, kb = (ca >= at) & (ca < at + WIDE), (cb >= at) & (cb < at + WIDE)
        x[ra[ka], ca[ka] - at] = 1
        y[rb[kb], cb[kb] - at] = 1
        both += x @ y.T
    return both.astype(np.int64)


def _within(width: int, percent: int, names: tuple[str, ...]):
    """Sorted by cell: the links of each cell. `side` is 0 (left), 1 (right) or null (both); comp is what is connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            nodes, comps, sides, sets = zip(*rows, strict=True)
            roots: dict[int, int] = {}
            forest = Forest([roots.setdefault(c, i) for i, c in enumerate(comps)])
            left, right = [i for i, s in enumerate(sides) if s != 1], [i for i, s in enumerate(sides) if s != 0]
            if found := compare(left, right, list(sets), forest, percent):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in a], pa.int64()), pa.array([nodes[i] for i in b], pa.int64())], names=["a", "b"])

        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in names), strict=True))
            for key, node, comp, side, text in zip(keys, b["node"].to_pylist(), b["comp"].to_pylist(), b["side"].to_pylist(), raw_texts(b["text"]), strict=True):
                if key != cell:
                    yield from close()
                    cell, rows = key, []
                rows.append((node, comp, side, shingle_set(text, width)))
        yield from close()

    return run


def links(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between nodes that give the components of all links."""
    n = partitions(docs.sparkSession)
    reps = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "keys")).alias("r"))
    keyed = reps.select(F.explode("r.keys").alias("key"), F.col("r.doc_id").alias("node"))
    met = keyed.repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node").mapInArrow(_hubs, "hub long, node long, key long")
    met = stage(met, "met")
    # Hubs of buckets that partitions share: two a partition at most.
    ends = met.where("key IS NOT NULL").select("key", "hub").distinct()
    tied = ends.join(ends.groupBy("key").agg(F.min("hub").alias("first")), "key").where("hub <> first").select(F.col("first").alias("hub"), F.col("hub").alias("node"))
    pairs = met.where("key IS NULL").select("hub", "node").union(tied).distinct()
    # A shared bucket's members meet every hub that it has.
    more = met.where("key IS NULL").select("hub", "node").join(tied.select(F.col("hub").alias("first"), F.col("node").alias("hub")), "hub").select(F.col("first").alias("hub"), "node")
    pairs = pairs.union(more).distinct()
    pairs = stage(pairs.union(pairs.select("hub", F.col("hub").alias("node")).distinct()).distinct(), "pairs")
    unstage(met)
    sized = pairs.join(signed.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n")), "node")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / MEMBERS)).cast("int")
    large = sized.groupBy("hub").agg(blocks.alias("blocks")).where("blocks > 1")
    # Only large groups are cut, and their members meet the cut in SALTS parts, so that no group's members meet in one task.
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["hub", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.drop("salt").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int"))
    nodes = pairs.select(F.col("node").alias("_n")).distinct()
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_d"), "text").join(nodes.hint("shuffle_hash"), F.col("_d") == F.col("_n"), "left_semi")
    rows = stage(placed.join(texts, F.col("node") == F.col("_d")).select("hub", "blocks", "block", "node", "text"), "members")
    cells = rows.select("hub", "block", "node", F.col("node").alias("comp"), F.lit(None).cast("int").alias("side"), "text")
    # The hub stands in each block of its group.
    hubs = rows.where("hub = node AND blocks > 1").select("hub", "block", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "text")
    hubs = hubs.where("`to` <> block").select("hub", F.col("to").alias("block"), "node", F.col("node").alias("comp"), F.lit(None).cast("int").alias("side"), "text")
    cells = cells.union(hubs).repartition(n, "hub", "block").sortWithinPartitions("hub", "block", "node")
    first = stage(cells.mapInArrow(_within(width, percent, ("hub", "block")), "a long, b long"), "links")
    unstage(pairs)
    large = rows.where("blocks > 1")
    if large.isEmpty():
        unstage(rows)
        return first
    # Across the blocks of large groups: members outside the largest component of a group, with all members.
    roots = components(first)
    large = large.join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("hub", "blocks", "block", "node", F.coalesce("root", "node").alias("comp"), "text")
    large = held = stage(large, "large")
    unstage(rows)
    sizes = large.groupBy("hub", "comp").agg(F.count("*").alias("c"), F.max("blocks").alias("blocks"))
    groups = sizes.groupBy("hub").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.max("blocks").alias("blocks")).where("all > m.c")
    # As many parts of the others as their share of the group's blocks, and at least one. A row a block, so that a group's rows don't meet in one task.
    parts = F.ceil((F.col("all") - F.col("m.c")) * F.col("blocks") / F.col("all")).cast("int")
    groups = stage(groups.select("hub", F.col("m.comp").alias("main"), parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "groups")
    large = large.join(groups, ["hub", "block"])
    left = large.where("comp <> main").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int"))
    left = left.select("hub", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "comp", F.lit(0).alias("side"), "text")
    right = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "node", "comp", F.lit(1).alias("side"), "text")
    cells = left.union(right.select(left.columns)).repartition(n, "hub", "part", "block").sortWithinPartitions("hub", "part", "block", "side", "node")
    across = stage(cells.mapInArrow(_within(width, percent, ("hub", "part", "block")), "a long, b long"), "links")
    unstage(held, groups)
    return first.union(across)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(texts.mapInArrow(_sign(width, bands, rows), "doc_id long, n long, digest binary, keys array<long>"), "signed")
    roots = components(links(docs, signed, width, percent))
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("_n"), "least")
    reps = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")).select(F.col("digest").alias("_g"), "rep")
    # Written, so that the join with all rows shuffles both sides anew and rows of a digest that many documents have can be split.
    nodes = stage(reps.join(named, F.col("rep") == F.col("_n"), "left").select("_g", F.coalesce("least", "rep").alias("component")), "nodes")
    out = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(nodes, F.col("digest") == F.col("_g"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document is its component's first, once each: a repeated row of it is a copy too."""
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias("_tq_d")).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_tq_d")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.o)
SELECT documents.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.o) AS component_id, documents.doc_id = min(r.o) AS kept
FROM documents JOIN r ON r.d = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id GROUP BY documents.doc_id
"""

"""Searches, mixes, packing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserql.llm import ann, exact_topk, mixing, packing
from tesserql.llm.common import table
from tesserql.llm.vectors import unpack

from ..compare import connection, same
from . import edges

# --- 3 and 9: vectors ----------------------------------------------------------------------------------------------


def vectors(spark, n=900, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[100:400] = v[50]  # ties
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [1.0, None] * (dim // 2), 0), (n + 3, [float("nan")] * dim, 0), (n + 4, [float("inf")] + [0.0] * (dim - 1), 0), (n + 5, [0.0] * dim, 0), (n + 6, [1.0] * 3, 0), (None, [1.0] * dim, 0), rows[0], rows[60]]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int").repartition(5)


def brute(rows, queries, k, transform, zero):
    ids = np.array([r[0] for r in rows])
    v = transform(np.array([r[1] for r in rows]))
    out = {}
    for q in queries:
        s = (v * v[ids == q][0]).sum(axis=1)
        ok = ids != q
        order = np.lexsort((ids[ok], -s[ok]))[:k]
        out[q] = list(zip(ids[ok][order].tolist(), s[ok][order].tolist(), strict=True))
    return out


def by_query(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def test_exact_topk(spark):
    rows, df = vectors(spark)
    got = by_query(exact_topk.search(df, F.col("vec_id") % 50 == 0))
    whole = [*rows, (905, [0.0] * 16, 0)]  # the zero vector takes part
    want = brute(whole, range(0, 900, 50), 5, lambda v: np.floor(256 * v).astype(np.int64), True)
    assert {q: x for q, x in got.items() if q < 900} == want
    assert 900 not in got


def test_searches_in_slices_and_blocks(spark, monkeypatch):
    """Queries in several blocks and slices, index in several blocks."""
    rows, df = vectors(spark, n=1200)
    for module in (ann, exact_topk):
        monkeypatch.setattr(module, "BLOCK_ROWS", 130)
        monkeypatch.setattr(module, "QUERY_ROWS", 25)
    monkeypatch.setattr("tesserql.llm.vectors.QUERY_ROWS", 25)
    monkeypatch.setattr("tesserql.llm.vectors.SLICE", 7)
    whole = [*rows, (1205, [0.0] * 16, 0)]
    got = by_query(exact_topk.search(df, F.col("vec_id") % 20 == 0))
    assert {q: x for q, x in got.items() if q < 1200} == brute(whole, range(0, 1200, 20), 5, lambda v: np.floor(256 * v).astype(np.int64), True)
    near, want = by_query(ann.search(df, F.col("vec_id") % 20 == 0)), brute(rows, range(0, 1200, 20), 20, lambda v: v, False)
    assert sum(len({i for i, _ in near[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_exact_topk_large_values(spark):
    rows = [(i, [float(3.0**i), -1e12, 1e15 * (i % 3)]) for i in range(30)]
    got = by_query(exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0))
    limit = 2**63 - 1
    for q in (0, 10, 20):
        v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
        s = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(v[q], v[i], strict=True)))), i) for i in v if i != q)[:5]
        assert got[q] == [(i, -x) for x, i in s]


def skewed(n=20_000, dim=64, seed=4):
    """Unit vectors around a few centres, half of them around one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = centres[np.where(rng.random(n) < 0.5, 0, rng.integers(0, 12, n))] + rng.normal(size=(n, dim)) * 0.6
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_exact_topk_touches_less_than_all():
    """Over three blocks: exact, and with fewer products than brute force has."""
    v = skewed()
    ids = np.arange(len(v))
    cell = exact_topk.Cell({"ids": ids[:200], "v": v[:200]})
    for at in range(0, len(v), 8192):
        cell.add(unpack(exact_topk.build_index(ids[at : at + 8192], v[at : at + 8192])[0]))
    whole = exact_topk.integers(v)
    scores = whole[:200] @ whole.T
    for q, (found, best) in enumerate(zip(*cell.best(), strict=True)):
        s = scores[q].copy()
        s[q] = -(2**60)
        order = np.lexsort((ids, -s))[:5]
        assert found == order.tolist() and best == s[order].tolist()
    assert cell.touched < 200 * v.size


def test_exact_topk_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, -5.0]), (1, [0.9, -5.0]), (2, [0.6, 0.0]), (50, [1e305, 1.0])]
    got = by_query(exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0))
    assert got[0] == [(50, 2**63 - 1), (1, 230 * 256), (2, 153 * 256)]


def test_exact_topk_sql(spark, sf_dir):
    same(exact_topk.op3_exact_topk(spark, sf_dir), connection(sf_dir), exact_topk.OP3_SQL)


def test_nearest_recall_and_scores(spark):
    rows, df = vectors(spark, n=3000, dim=32, seed=2)
    got = by_query(ann.search(df, F.col("vec_id") % 20 == 0))
    want = brute(rows, range(0, 3000, 20), 20, lambda v: v, False)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.95
    for q, found in got.items():
        if q < 3000:
            assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
            assert all(abs(s - float(np.dot(np.array(rows[q][1]), np.array(rows[i][1])))) < 1e-9 for i, s in found)


def test_nearest_recall_where_few_are_reranked():
    v = skewed(24_576)
    ids = np.arange(len(v))
    own = ann.Quantiser.fit(v[:4096])
    cell = ann.cell_of({64: own.centres})({"ids": ids[:200], "v": v[:200]})
    for at in range(0, len(v), 8192):
        cell.add(unpack(ann.encode_block({64: own.centres}, {64: own.eta})(ids[at : at + 8192], v[at : at + 8192])[0]))
    hit, scores = 0, v[:200] @ v.T
    for q, found in enumerate(cell.best()[0]):
        s = scores[q].copy()
        s[q] = -9
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(found))
    assert cell.reranked <= 0.02 * 200 * len(v)
    assert hit >= 0.9 * 200 * 20


def test_nearest_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, -5.0]), (1, [0.9, -5.0]), (2, [0.6, 0.0])]
    got = by_query(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0))
    assert got[0] == [(1, 0.9), (2, 0.6)]


def test_nearest_recall_on_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    got = by_query(ann.op9_nearest(spark, sf_dir))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20, lambda v: v, False)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ann.search(none, F.col("vec_id") % 20 == 0).count() == 0
    assert exact_topk.search(none, F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert by_query(ann.search(few, F.col("vec_id") % 20 == 0)) == {0: [(1, 4.0)]}


# --- 7: mixing -----------------------------------------------------------------------------------------------------


def drawn(docs, **more):
    return mixing.draws(*mixing.planned(docs, **more))


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Filled step by step: what a full source leaves goes to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set = set()
    while True:
        level = (sum(sizes) - sum(most * sizes[i] for i in full)) / (sum(w[i] for i in range(len(w)) if i not in full) or 1)
        more = {i for i in range(len(w)) if i not in full and level * w[i] > most * sizes[i]}
        if not more:
            return [most * sizes[i] if i in full else level * w[i] for i in range(len(w))]
        full |= more


@pytest.mark.parametrize("sizes", [[10, 1000, 5, 300, 0, 70], [0, 0], [7], [1, 1, 1, 5000], [3, 10**9, 2, 2, 10**6]])
def test_targets(spark, sizes):
    names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
    blocks = spark.createDataFrame([(n, x // 2) for n, x in zip(names, sizes, strict=True)] + [(n, x - x // 2) for n, x in zip(names, sizes, strict=True)], "source string, words long")
    got = {r["source"]: r["target"] for r in mixing.targets(blocks).collect()}
    assert [got[n] for n in names] == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes))
    assert mixing.targets(blocks.where("false")).count() == 0


def test_split_tree():
    have = np.array([7, 0, 100, 13])
    quotas = mixing.even(120, 6)
    out = mixing.split_tree(have, quotas, [4])
    assert (out.sum(axis=0) == have).all() and (out.sum(axis=1) == quotas).all() and (out == mixing.split_tree(have, quotas, [4])).all()
    # A shard's share of a source varies as a draw without replacement does.
    many = np.array([mixing.split_tree(have, quotas, [s])[0, 2] for s in range(400)])
    assert abs(many.mean() - 100 / 6) < 0.4 and 0.5 < many.var() / (20 * (100 / 120) * (20 / 120) * (100 / 119)) < 1.6


def check_mix(spark, docs):
    """The copies that the mix writes are those that are planned, near their targets, never more than three, in every shard its quota."""
    rows = drawn(docs).collect()
    sums, planned = defaultdict(int), Counter()
    for r in rows:
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
        sums[r["source"], r["target"], r["source_size"]] += r["taken"]
        planned[r["doc_id"], r["source"], r["size"]] += r["times"]
    groups = Counter()
    for r in docs.select("doc_id", "source", "text", mixing.word_count(F.col("text")).alias("n")).collect():
        groups[r["doc_id"], r["source"], r["text"]] += r["n"]
    largest = max(groups.values(), default=0)
    assert all(abs(taken - target) <= largest for (_, target, _), taken in sums.items())
    mixed = mixing.mix(docs).select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"), "mix_shard", "mix_place").collect()
    assert Counter((r["doc_id"], r["source"], r["n"]) for r in mixed) == +planned
    again = mixing.mix(docs).select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"), "mix_shard", "mix_place").collect()
    assert sorted(map(tuple, mixed), key=repr) == sorted(map(tuple, again), key=repr)
    return rows


def test_mix(spark, sf_dir):
    check_mix(spark, table(spark, sf_dir, "documents"))


def test_mix_sql(spark, sf_dir):
    same(mixing.op7_mix_sources(spark, sf_dir), connection(sf_dir), mixing.OP7_SQL)


def test_mix_edges(spark):
    docs = edges.documents(spark).withColumn("mix_shard", F.lit("old")).withColumn("block", F.lit(1)).withColumn("_s", F.lit(2)).withColumn("times", F.lit(3))
    assert len(check_mix(spark, docs)) == docs.count()
    assert mixing.mix(docs).columns == [*[c for c in docs.columns if c != "mix_shard"], "mix_shard", "mix_place"]
    assert mixing.in_order(mixing.mix(docs)).count() > 0
    assert drawn(edges.empty(spark)).count() == 0
    assert mixing.mix(edges.empty(spark)).count() == 0


def test_mix_of_repeated_rows_null_ids_and_empty_texts(spark, tmp_path):
    rows = [(None, f"{'w ' * (n % 4 + 1)}", s) for s in ("a", "b", None) for n in range(40)] + [(1, "x y", "a")] * 9 + [(n // 2, "p q r", "c") for n in range(200)] + [(n, None if n % 2 else "", "d") for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    check_mix(spark, docs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(mixing.op7_mix_sources(spark, str(tmp_path)), connection(str(tmp_path)), mixing.OP7_SQL)


def test_mix_of_many_sources(spark, tmp_path):
    """A source a host: nothing is gathered or dealt by source alone."""
    spark.range(60000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 11 as int)) AS text", "concat('host', if(id < 20000, 0, id % 20011)) AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op7_mix_sources(spark, str(tmp_path))
    same(got, connection(str(tmp_path)), mixing.OP7_SQL)


def test_mix_query_takes_what_the_mix_emits(spark, sf_dir, monkeypatch):
    whole = mixing.emit
    monkeypatch.setattr(mixing, "emit", lambda *a: whole(*a).where("mix_shard <> 3"))
    got = sum(r["taken"] for r in mixing.op7_mix_sources(spark, sf_dir).collect())
    kept = whole(table(spark, sf_dir, "documents"), mixing.planned(table(spark, sf_dir, "documents"))[1]).where("mix_shard <> 3")
    assert got == kept.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]


def test_mix_shards_and_order(spark, sf_dir):
    out = mixing.in_order(mixing.mix(table(spark, sf_dir, "documents"))).select(F.spark_partition_id().alias("p"), "mix_shard", "mix_place").collect()
    assert {r["mix_shard"] for r in out} == set(range(mixing.SHARDS))
    by_partition = defaultdict(list)
    for r in out:
        by_partition[r["p"]].append((r["mix_shard"], r["mix_place"]))
    assert all(x == sorted(x) for x in by_partition.values())
    whole = [x for p in sorted(by_partition) for x in by_partition[p]]
    assert whole == sorted(whole)
    sizes = mixing.in_order(spark.range(20_000).select((F.col("id") % 16).cast("int").alias("mix_shard"), F.xxhash64("id").alias("mix_place"))).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1.3 * 20_000 / 16


# --- 10: packing ---------------------------------------------------------------------------------------------------


def check_packing(pieces, texts, capacity=2048):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    lengths, places = Counter(), defaultdict(list)
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    by_doc = defaultdict(dict)
    for p in pieces:
        by_doc[p["doc_id"]].setdefault(p["piece"], p)
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        raw = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()
        assert p["ids_crc32"] == zlib.crc32(raw) and p["length"] == len(raw) // 4
        lengths[p["length"]] += 1
    for d, own in by_doc.items():
        assert [(own[k]["start"], own[k]["length"]) for k in sorted(own)] == packing.cuts(len(ids[d]), capacity)
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places), -(-sum(n * c for n, c in lengths.items()) // capacity)


def test_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    used, least = check_packing(packing.pack(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert used <= least + 1


def test_packing_edges(spark):
    docs = edges.documents(spark).where("doc_id IS NOT NULL AND text <> 'another text of document six' OR doc_id IS NOT NULL AND text IS NULL")
    pieces = packing.pack(docs).collect()
    check_packing(pieces, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert packing.pack(edges.documents(spark)).count() >= edges.documents(spark).count()
    assert packing.pack(edges.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, [200, 2049, 1100, 700, 30, 2049][seed], 5000).tolist())
    depth, plan = packing.plan(counts)
    assert plan == packing._plan(counts, 2048, depth)
    placed = Counter()
    for lengths, m in plan:
        assert sum(lengths) <= 2048
        for n in lengths:
            placed[n] += m
    assert placed == counts
    used, least = sum(m for _, m in plan), -(-sum(n * c for n, c in counts.items()) // 2048)
    best = sum(m for _, m in packing.best_fit(counts))
    assert least <= used <= best + 1


def test_triples_fill_gaps_on_natural_lengths():
    rng = np.random.default_rng(3)
    counts = Counter(np.clip(np.exp(rng.normal(5.5, 1, 40_000)).astype(int), 1, 2048).tolist())
    plan = packing._plan(counts, 2048, 3)
    exact = [(lengths, m) for lengths, m in plan if sum(lengths) == 2048]
    assert any(len(lengths) == 4 for lengths, _ in exact)
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert sum(m for _, m in packing.plan(counts)[1]) <= least * 1.001 + 1 and sum(m for _, m in exact) > 0.9 * least


def test_packing_of_repeated_rows(spark):
    rows = [(7, "same words " * 40)] * 300 + [(None, None)] * 5 + [(8, "x " * 5000)] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    places = Counter((r["sequence_id"], r["offset"]) for r in got)
    assert max(places.values()) == 1 and Counter(r["doc_id"] for r in got)[7] == 300 and Counter(r["doc_id"] for r in got)[None] == 5
    per = defaultdict(int)
    for r in got:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 2048


def test_token_ids_are_those_of_the_file(spark, sf_dir):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder()
    texts = [r["text"] for r in table(spark, sf_dir, "documents").collect()] + ["", " ", "a  b\n\n c\t", "it's 12'll <|endoftext|> x", "\u2003x\u00a0 y\x1cz", "漢字 ñ"]
    for t in texts:
        assert np.frombuffer(own(t), dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# --- the pipeline --------------------------------------------------------------------------------------------------


def test_mix_stage_keeps_the_order_of_the_mix(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    at = defaultdict(set)
    for r in mixing.mix(docs).select("doc_id", "mix_shard").collect():
        at[r["doc_id"]].add(r["mix_shard"])
    out = corpus_pipeline.mix_stage(spark, docs, sf_dir).select(F.spark_partition_id().alias("p"), "doc_id").collect()
    seen = defaultdict(list)
    for r in out:
        if len(at[r["doc_id"]]) == 1:
            seen[r["p"]] += at[r["doc_id"]]
    assert seen and all(x == sorted(x) for x in seen.values())


def test_stages_on_hard_rows(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, and nothing at all: each stage has its result, column for column."""
    import corpus_pipeline

    docs = edges.documents(spark).withColumn("shard", F.lit(1)).withColumn("_d", F.lit("x")).withColumn("score", F.lit(0.5)).withColumn("n_dropped", F.lit(3))
    rows = {k: Counter(map(repr, step(spark, docs, sf_dir).collect())) for k, step in corpus_pipeline.STAGES}
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, sf_dir).dtypes == docs.dtypes
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.where("false"), sf_dir).count() == 0
    own = Counter(map(repr, docs.collect()))
    assert rows["quality classifier"] <= own
    lined = corpus_pipeline.line_stage(spark, docs, sf_dir).collect()
    assert len(lined) == docs.count() and not any(edges.COMMON in r["text"] for r in lined if r["doc_id"] and r["doc_id"] >= 100)
    assert all(r["n_chars"] == len(r["text"]) for r in lined if r["doc_id"] and r["doc_id"] >= 100)
    near = corpus_pipeline.near_stage(spark, docs, sf_dir).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in near)
    assert max(texts.values()) == 1 and (None, "no id") in texts and (8, edges.LONG) not in texts and (7, edges.LONG) in texts
    mixed = Counter(map(repr, corpus_pipeline.mix_stage(spark, docs, sf_dir).collect()))
    assert set(mixed) <= set(own) and all(mixed[r] <= 3 * own[r] for r in mixed)
    packed = corpus_pipeline.pack_stage(spark, docs, sf_dir).collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()


def test_pipeline_against_its_parts_by_brute_force(spark, tmp_path):
    """A small corpus whose stages can be followed by hand: junk goes, a line of ten documents goes, copies leave the first, the mix takes what sources' targets allow, and every taken copy is packed."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    good = [(i, "\n".join([" ".join(f"w{rng.integers(4000)}" for _ in range(30)) + "." for _ in range(3)]), f"s{i % 2}") for i in range(60)]
    good = [(i, t + "\nThe same line stands here." if i < 12 else t, s) for i, t, s in good]
    copies = [(100 + i, good[i][1], "s0") for i in (20, 21)]
    junk = [(200 + i, "$$$ 0 0 0 " * 40, "s1") for i in range(40)]
    rows = [(d, t, "en", s, len(t)) for d, t, s in good + copies + junk]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 200), 0) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, outs = table(spark, str(tmp_path), "documents"), []
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, str(tmp_path)).collect(), docs.schema)
        outs.append(docs.collect())
    assert {r["doc_id"] for r in outs[0]} == {d for d, *_ in rows if d < 200}
    assert {r["doc_id"]: r["text"] for r in outs[1]} == {d: t.replace("\nThe same line stands here.", "") for d, t, *_ in rows if d < 200}
    assert {r["doc_id"] for r in outs[2]} == set(range(60))
    sizes = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in outs[2]}
    whole = [sum(n for s, n in sizes.values() if s == name) for name in ("s0", "s1")]
    taken = Counter()
    for r in outs[3]:
        taken[r["source"]] += sizes[r["doc_id"]][1]
    assert all(abs(taken[name] - t) <= 90 for name, t in zip(("s0", "s1"), plain_targets(whole), strict=True))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in outs[3])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from tesserql.llm.common import stage

    docs, seen = table(spark, sf_dir, "documents"), []
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert out.dtypes == docs.dtypes
        docs = stage(out, f"t{k}")
        seen.append(docs)
    good, lines, near, mixed, packed = (s.collect() for s in seen)
    assert 0 < len(good) <= table(spark, sf_dir, "documents").count()
    assert {r["doc_id"] for r in lines} == {r["doc_id"] for r in good}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    assert {r["doc_id"] for r in near} <= {r["doc_id"] for r in lines} and len(near) == len({r["doc_id"] for r in near})
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    assert len({(r["doc_id"]) for r in packed}) == len({r["doc_id"] for r in mixed})
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)

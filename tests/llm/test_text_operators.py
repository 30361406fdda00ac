"""Filters, deduplication and scans over texts, against brute force on small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserql.llm import components, licenses, line_dedup, near_dedup, quality, shingles, substring_dedup, url_filter
from tesserql.llm.common import table

from ..compare import connection, same
from . import edges

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 1: urls -------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = {
        "http://a.Example.ORG/en/1x?q": ("a.example.org", "/en/1x", "example.org/en/1", "block"),
        "https://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "https://example.org/es": ("example.org", "/es", "org/", "allow"),
        "x://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "http://b.com/fr/2#x": ("b.com", "/fr/2", "com/fr/", "allow"),
        "http://b.com/de/2": ("b.com", "/de/2", "com/de/", "block"),
        "http://org?x=1": ("org", "", None, None),
        "http://a.net#/org/": ("a.net", "", None, None),
        "nothing": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://b\nc.org/x://y": ("b\nc.org", "/x://y", "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "extra", 0.5) for i, u in enumerate(urls)] + [(None, "http://z.net/", None, None)], "page_id long, url string, host string, score double")
    model = url_filter.train(url_filter.labelled_by_rules(pages))
    got = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert len(got) == len(urls) + 1
    assert url_filter.judge(pages.where("false"), model).count() == 0
    assert url_filter.train(url_filter.labelled_by_rules(pages.where("false"))).score([b"^a$ /|"])[0] < 0.5


def test_url_model_learns():
    rng = np.random.default_rng(0)
    urls = [(b"s%d.example.com" % rng.integers(50), b"/%s/%d" % (lang, rng.integers(9999)), lang == b"de") for _ in range(600) for lang in [rng.choice([b"de", b"fr", b"en"])]]
    texts, labels = url_filter.framed([u[0] for u in urls], [u[1] for u in urls]), [int(u[2]) for u in urls]
    model = url_filter.UrlModel.fit(texts[:400], labels[:400])
    assert ((model.score(texts[400:]) >= 0.5) == np.array(labels[400:])).mean() > 0.97


def plain_judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host, best = host.translate(LOWER), None
    for rule, verdict in url_filter.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_url_filter_on_the_table(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    urls = {r["page_id"]: r["url"] for r in table(spark, folder, "pages").collect()}
    got = url_filter.op1_url_filter(spark, folder).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain_judge(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_url_model_on_pages_it_has_not_seen(spark, sf_dir):
    """Half of what rules label is learnt, the other half judged."""
    labelled = url_filter.labelled_by_rules(table(spark, sf_dir.replace("sf0.001", "sf0.1"), "pages"))
    half = F.crc32(F.col("url").cast("binary")) % 2 == 0
    model = url_filter.train(labelled.where(half))
    host, path = url_filter.host_and_path(F.col("url"))
    rest = labelled.where(~half).select(host.alias("h"), path.alias("p"), "label").collect()
    right = (model.score(url_filter.framed([r["h"].encode() for r in rest], [r["p"].encode() for r in rest])) >= 0.5) == np.array([r["label"] for r in rest])
    assert len(rest) > 100 and right.mean() > 0.95


def test_urls_long_and_repeated(spark):
    rows = [(1, "http://a.com/de/" + "x" * 200_000), (2, "http://u.info/de/1"), (2, "http://u.info/de/1"), (None, None), (3, "http://" + "h" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.judge(pages, url_filter.train(spark.createDataFrame([("http://a/de/1", 1), ("http://a/fr/1", 0)] * 3, "url string, label int"), most=4)).collect()
    assert len(got) == 5 and len({(r["host"], r["path"], r["verdict"], r["score"]) for r in got if r["page_id"] == 2}) == 1
    assert {r["page_id"]: len(r["path"]) for r in got}[1] == 200_004


# --- 2: lines ------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    docs = {(d, t) for d, t in rows}
    key = lambda line: line.strip(SPACE).translate(LOWER)
    count = defaultdict(int)
    for _, t in docs:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            count[k] += 1
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and count[key(x)] >= least)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 10, 13])
def test_line_dedup(spark, least):
    docs = edges.documents(spark)
    got = line_dedup.apply_keep(docs.withColumnRenamed("n_lines", "lines_of"), line_dedup.keep_bitmaps(docs, least)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()], least)


def test_line_dedup_hot_line_over_partitions(spark):
    rows = [(i, "hot\n" + f"rare {i % 150}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs, 10)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, 10)


def test_line_dedup_sql(spark, sf_dir):
    same(line_dedup.op2_line_dedup(spark, sf_dir), connection(sf_dir), line_dedup.OP2_SQL)


def test_line_dedup_empty(spark):
    docs = edges.empty(spark)
    assert line_dedup.keep_bitmaps(docs).count() == 0


# --- 4: quality ----------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in quality.op4_quality(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    held = [d for d in labels if got[d]["held_out"]]
    assert len(got) == table(spark, folder, "documents").count() and len(held) > 80
    assert sum(got[d]["predicted"] == labels[d] for d in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_quality_edges(spark):
    docs = edges.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert quality.score(docs, model).count() == docs.count()
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (4, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, some)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(edges.empty(spark), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_model_is_its_tables(spark, sf_dir):
    """The scores of whole texts, term by term from the tables; a repeated document is learnt once."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    again = quality.train(docs.union(docs).repartition(7), labels.union(labels))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        x = quality.features(r["text"].encode())
        place = lambda edges, v: sum(e <= v for e in edges)
        z = model.bias + sum(t[place(c, v)] for c, t, v in zip(model.cuts, model.tables, x, strict=True)) + sum(t[place(c, x[f]), place(d, x[g])] for (f, g), (c, d, t) in model.pairs.items())
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-9
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


@pytest.mark.parametrize("word", [b"ALL", b"Don't", b"\"Quoted\"", b"Well-known", b"plain"])
def test_quality_capital_words_at_every_length(word):
    k = quality.NAMES.index("capital_words")
    assert len({quality.features(b" ".join([word] * n))[k] for n in (10, 4999, 5000, 6000)}) == 1


# --- 5: passages ---------------------------------------------------------------------------------------------------


def plain_words(text):
    return [(m.group().translate(LOWER), *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def word_runs(rows, least):
    """By document, the places of words that lie in a window of `least` words which an earlier document has."""
    first, out = {}, {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        words = [w for w, _, _ in plain_words(t)]
        windows = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        out[d, t] = {i for k, w in enumerate(windows) if first.setdefault(w, (d, t)) != (d, t) for i in range(k, k + least)}
    return out


def reported(rows, spans):
    out = {(d, t): set() for d, t in rows}
    texts = {d: t for d, t in rows}
    for r in spans:
        words = plain_words(texts[r["doc_id"]])
        at = [i for i, (_, lo, hi) in enumerate(words) if lo >= r["start"] and hi <= r["end"]]
        assert words[at[0]][1] == r["start"] and words[at[-1]][2] == r["end"] and len(at) == r["words"]
        out[r["doc_id"], texts[r["doc_id"]]] |= set(at)
    return out


def runs(places):
    places, out = sorted(places), []
    for i in places:
        if out and out[-1][-1] == i - 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def check_spans(rows, spans):
    """Both ways, against windows of words: passages of over 50 words but for their ends, and nothing that isn't repeated for LEAST words."""
    got, long, short = reported(rows, spans), word_runs(rows, 51), word_runs(rows, substring_dedup.LEAST)
    w, found = substring_dedup.WINDOW, 0
    for key in got:
        assert got[key] <= short[key]
        for run in runs(long[key]):
            found += 1
            assert set(run[w - 1 : len(run) - 2 * w + 2]) <= got[key], key
    return found


def passages(seed):
    """Documents with parts of 20 to 80 words of one text anywhere in their own, short unique lines between repeated ones, and upper-cased and respaced copies."""
    rng = np.random.default_rng(seed)
    said = lambda n: " ".join(f"{'Aé'[rng.integers(2)]}{rng.integers(3000)}" + (" " * rng.integers(1, 3) if rng.random() < 0.1 else "\n" if rng.random() < 0.05 else "") for _ in range(n))
    parts = [x.group() for x in re.finditer(r"\S+\s*", said(400))]
    rows = [(0, f"One {''.join(parts)} end.")]
    for i in range(1, 60):
        lo, n = int(rng.integers(0, 320)), int(rng.choice([20, 32, 51, 60, 80]))
        part = "".join(parts[lo : lo + n])
        rows.append((i, f"{said(int(rng.integers(1, 15)))} {part.replace('A', 'a') if i % 2 else part} {said(int(rng.integers(0, 15)))} and so on."))
    for i in range(60, 70):
        rows.append((i, f"{''.join(parts[100:151])}\nMy pin: {i * 37}\n{''.join(parts[200:251])}"))
    return rows


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_repeated_passages(spark, tmp_path, seed):
    rows = passages(seed)
    spark.createDataFrame([(d, t, "x") for d, t in rows + rows[:4]], "doc_id long, text string, start string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spans = substring_dedup.op5_substring_dedup(spark, str(tmp_path)).collect()
    assert len(spans) == len({(r["doc_id"], r["start"]) for r in spans}) + sum(r["doc_id"] < 4 for r in spans) / 2
    assert check_spans(rows, spans) > 30
    docs = table(spark, str(tmp_path), "documents")
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_spans(docs, substring_dedup.repeated_passages(docs)).collect()}
    gone = defaultdict(list)
    for r in spans:
        gone[r["doc_id"]].append((r["start"], r["end"]))
    for d, t in rows:
        at, kept = 0, ""
        for lo, hi in sorted(set(gone[d])):
            kept, at = kept + t[at:lo], hi
        assert cut[d] == kept + t[at:]
        assert {(r["kept_chars"], r["kept_sha256"]) for r in spans if r["doc_id"] == d} <= {(len(cut[d]), hashlib.sha256(cut[d].encode()).hexdigest())}
    assert all(f"{i * 37}\n" in cut[i] for i in range(60, 70))


def test_hot_passage_over_many_partitions(spark):
    rows = passages(8)
    hot = " ".join(f"hot{i}" for i in range(90))
    rows += [(i, f"own{i} words{i} {hot} tail{i}") for i in range(100, 900)] + [(i, hot) for i in range(900, 1000)]
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(11)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        spans = substring_dedup.repeated_passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert check_spans(rows, spans) > 900
    assert {min(r["first_doc_ids"]) for r in spans if r["doc_id"] > 100} == {100}


def test_repeated_passages_on_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert check_spans(rows, substring_dedup.op5_substring_dedup(spark, sf_dir).collect()) > 0


def test_cuts_are_the_words_own():
    rng, w = np.random.default_rng(1), substring_dedup.WINDOW
    h = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for n in (0, 1, 2, 5, 60):
        assert set(substring_dedup.cuts(h[:n]).tolist()) <= set(range(max(n - 1, 0)))
    whole = substring_dedup.cuts(np.concatenate([rng.integers(0, 2**63, 33, dtype=np.uint64), h, rng.integers(0, 2**63, 9, dtype=np.uint64)])) - 33
    own = [c for c in substring_dedup.cuts(h).tolist() if w <= c < 58 - w]
    assert own == [c for c in whole.tolist() if w <= c < 58 - w]
    assert np.diff(whole).max() <= substring_dedup.WINDOW


def test_passages_of_edges(spark):
    docs = edges.documents(spark)
    spans = substring_dedup.repeated_passages(docs)
    assert {r["doc_id"] for r in spans.collect()} == {8}
    assert substring_dedup.remove_spans(docs, spans).count() == docs.count()
    assert substring_dedup.repeated_passages(edges.empty(spark)).count() == 0
    text = " ".join(f"w{i}" for i in range(70))
    rows = spark.createDataFrame([(None, text), (None, text), (None, text + " more"), (3, text), (3, None), (4, text + " " + text)], "doc_id long, text string")
    assert {(r["doc_id"], tuple(r["first_doc_ids"])) for r in substring_dedup.repeated_passages(rows).collect()} == {(None, (None,)), (3, (None,)), (4, (None,))}


# --- 6: near-duplicates --------------------------------------------------------------------------------------------


def brute_near(rows, width, percent=80):
    sets = defaultdict(list)
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d].append(frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]))
    up = {d: d for d in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {(d, len(s), find(d) if d is not None else None) for d, ss in sets.items() for s in ss}


def near_rows():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        base = [f"w{g}x{i}" for i in range(120)]
        for k in range(14 if g else 60):
            words = list(base)
            for at in rng.choice(120, rng.integers(0, 7), replace=False):
                words[at] = f"e{rng.integers(1000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("width, block", [(2, 1 << 18), (2, 900), (5, 1 << 18), (5, 600)])
def test_near_duplicates(spark, monkeypatch, width, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, width).collect()}
    assert got == brute_near(rows, width)


def test_near_duplicates_of_a_short_template(spark, monkeypatch):
    """Thousands of texts that share bands but no link: blocks are bounded by documents too."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 300)
    held = []
    plain = near_dedup.compare
    monkeypatch.setattr(near_dedup, "compare", lambda left, right, *a: held.append(len(left) * len(right)) or plain(left, right, *a))
    rows = [(i, f"your order number {i} has shipped") for i in range(3000)] + [(5000 + i, f"your order number {i} has shipped") for i in range(0, 3000, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == {(d, 5, int(t.split()[3])) for d, t in rows}


def test_compare_in_tiles(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(150)]
    left, right = list(range(100)), list(range(50, 150))
    linked = lambda: near_dedup.compare(left, right, sets, near_dedup.Forest(list(range(150))), 40)
    whole = linked()
    monkeypatch.setattr(near_dedup, "TILE", 7)
    assert len(linked()) == len(whole) > 10
    for i, j in whole:
        assert shingles.jaccard_at_least(sets[i], sets[j], 40)


def test_near_duplicates_edges(spark):
    docs = edges.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_dedup.near_duplicates(docs, 2).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_near(rows, 2)
    kept = near_dedup.keep_first(docs, 2)
    assert kept.columns == docs.columns
    assert near_dedup.near_duplicates(edges.empty(spark)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    maps, errors = shingles.MinMax(60, 6), []
    for _ in range(60):
        u = rng.integers(0, 2**63, 700, dtype=np.uint64) * np.uint64(2)
        x, y = u[:500], u[100:600]
        errors.append((maps.signature(x) == maps.signature(y)).mean() - 400 / 600)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 1000 + i) for i in range(1, 40)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = defaultdict(set)
    for r in rows:
        roots[r["root"]].add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(61)), [100, 200, 300], list(range(1000, 1040))]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8: licenses ---------------------------------------------------------------------------------------------------


def test_patience_alignment():
    assert licenses.align("a b c d e".split(), "a x c d e".split()) == [(0, 0), (2, 2), (3, 3), (4, 4)]
    assert licenses.align([], ["a"]) == []
    assert licenses.longest_increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]


def test_license_scan(spark):
    texts = ["Before. Released under the MIT License. After.", "licensed  UNDER\nthe apache license, version 2.0", "We licensed a song.", "", None, edges.LONG + " This work is licensed under the GNU General Public License, version 3. " + edges.LONG, "Licensed under CC BY-NC 4.0. Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], None)], "doc_id long, text string, license string")
    got = sorted(((r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()), key=repr)
    assert got == sorted([(0, "MIT"), (1, "Apache-2.0"), (5, "GPL-3.0"), (6, "CC-BY-NC-4.0"), (6, "MIT"), (None, "MIT")], key=repr)
    for r in licenses.scan_licenses(docs.where("doc_id = 0")).collect():
        assert texts[0][r["start"] : r["end"]] == "Released under the MIT License"
    assert licenses.scan_licenses(edges.empty(spark)).count() == 0


OWN = [licenses.Template(*t) for t in licenses.TEMPLATES]


def test_license_at_the_least_coverage():
    text = licenses.TEMPLATES[2][1]
    for word in ("hereby", "granted", "charge", "obtaining"):
        text = text.replace(word, f"x{word}")
    assert [(f[0], f[3]) for f in licenses.scan(text, OWN)] == [("MIT", 23)]


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_every_template_is_found_whole(k):
    """Also inside other words, misspelt, and with words put in."""
    name, text = licenses.TEMPLATES[k]
    noise = "Some words of a page that stand before and after it and are not of the text at all."
    for changed in (text, text.upper().replace(" ", "\n * "), re.sub(r"(?i)licen[sc]e(?=d? )", "licens", text, count=1) if len(text.split()) > 8 else text, text.replace(" the ", " the very old ", 3)):
        found = licenses.scan(f"{noise} {changed} {noise}", OWN)
        assert [f[0] for f in found] == [name], changed
        whole = f"{noise} {changed} {noise}"[found[0][1] : found[0][2]]
        assert changed.strip().startswith(whole[:8]) or found[0][4] < 1


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = best[:]
        for j, y in enumerate(b):
            best[j + 1] = before[j] + 1 if x == y else max(best[j], before[j + 1])
    return best[-1]


def test_license_scan_against_brute_force():
    """Every stretch of every text: where an alignment of one covers a template there is a find in it or over it, and no find without a common subsequence as long."""
    rng = np.random.default_rng(2)
    short = [t for t in OWN if len(t.words) <= 30]
    vocabulary = sorted({w for t in short for w in t.words})
    for _ in range(60):
        words = []
        for _ in range(3):
            words += rng.choice(vocabulary, rng.integers(0, 12)).tolist()
            part = list(short[rng.integers(len(short))].words)
            for _ in range(rng.integers(0, 5)):
                at = rng.integers(len(part))
                part[at : at + rng.integers(0, 2)] = [str(rng.choice(vocabulary))] * rng.integers(0, 2)
                part = part or ["x"]
            words += part
        found = licenses.scan(" ".join(words), OWN)
        places = [(m.start(), m.end()) for m in re.finditer(r"\S+", " ".join(words))]
        for _, start, end, matched, coverage in found:
            own = [w for w, (lo, hi) in zip(words, places, strict=True) if start <= lo and hi <= end]
            assert any(coverage == matched / len(t.words) and longest_common(own, t.words) >= matched >= t.need for t in OWN)
        for t in short:
            for at in range(len(words)):
                pairs = licenses.align(words[at : at + t.reach], t.words)
                if len(pairs) >= t.need:
                    lo, hi = places[at + pairs[0][0]][0], places[at + pairs[-1][0]][1]
                    assert any(f[1] < hi and f[2] > lo for f in found), (t.name, words)


def test_license_templates_are_an_argument(spark):
    docs = spark.createDataFrame([(1, "Use it kindly, dear reader, and pass it on."), (2, "Licensed under the MIT License.")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs, (("Kind", "use it kindly dear reader"),)).collect()] == [(1, "Kind")]


def test_license_scan_finds_all_notices(spark, sf_dir):
    want = {r["doc_id"] for r in table(spark, sf_dir, "documents").collect() if re.search(r"[Ll]icensed? (under|by)|MIT License", r["text"])}
    assert {r["doc_id"] for r in licenses.op8_license_scan(spark, sf_dir).collect()} == want

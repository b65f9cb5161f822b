"""Near duplicates, vector joins, search and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import simhash, topk_search, vector_join
from textloom.llm.components import connected_components, unite


def classes(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    pairs += pairs[:20] + [(7, 7), (None, 3), (3, None)]
    got = {r["node"]: r["component_id"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    real = [(a, b) for a, b in pairs if None not in (a, b) and a != b]
    assert got == classes({x for p in real for x in p}, real)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.components.SALTS", 3)
    edges = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(300, 480)] + [(199, 300), (7, 7), (None, 3), (0, 1), (900, 901)]
    got = {r["node"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(200), *range(300, 480), 500]} | {900: 900, 901: 900}


def test_unite_merges_in_place():
    labels = np.arange(6)
    unite(labels, np.array([5, 1]), np.array([4, 5]))
    assert labels.tolist() == [0, 1, 2, 3, 1, 1]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def documents(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    texts = [None, "", " \t\n", "one", "one two", "ONE two\u00a0x", "É É É É"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            near[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(near).upper() if rng.random() < 0.5 else "\n".join(near))
    texts += ["same words here again"] * 50 + ["long text " * 30000]
    return spark.createDataFrame([(i * 3, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int").repartition(4), {i * 3: t for i, t in enumerate(texts)}


def test_xxhash_of_the_engine_is_the_library_s(spark):
    row = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("part", [4096, 3])
def test_simhash_groups_equal_brute_force(spark, part, monkeypatch):
    df, texts = documents(spark)
    monkeypatch.setattr(simhash.near_links, "__defaults__", (2, part))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    want = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == want
    pairs = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in got.items()} == classes(want, pairs)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_bk_forest_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    fp = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) * np.uint64(0x1000400010001))
    group = np.sort(rng.integers(0, 4, len(fp)))
    found = set()
    for q, n in simhash.BKForest(fp, group).search(fp, group, radius):
        found |= set(zip(q.tolist(), n.tolist(), strict=True))
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    assert found == want


def vectors(spark, n=700, dim=12, kind="float"):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[100:300] = x[7] + rng.normal(size=(200, dim)) * 0.13  # a hot group
    x[300:330] = x[8] * 3
    x[400] = 0
    rows = [(int(i), [float(v) for v in (np.float32(r) if kind == "float" else r)], 1) for i, r in enumerate(x)]
    rows[401] = (401, None, 1)
    rows[402] = (402, [None] + rows[402][1][1:], 1)
    rows[403] = (403, [float("nan")] + rows[403][1][1:], 1)
    rows[404] = (404, [float("inf")] + rows[404][1][1:], 1)
    rows[405] = (405, [], 1)
    rows[406] = (406, rows[7][1] + [0.0], 1)  # of another length
    rows[407] = (407, [v * 1e-30 for v in rows[7][1]], 1)
    rows += [rows[9], rows[9], (None, rows[7][1], 1), (9, rows[7][1], 1), (None, rows[500][1], 1), (None, None, 1)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n_links int").repartition(5), rows


def units(rows, kind="float"):
    """Position: unit vector, of the rows that have one."""
    out = {}
    for at, (_, v, _) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(np.float32(v) if kind == "float" else v, dtype=np.float64)
            x = x / np.abs(x).max()
            out[at] = x / np.linalg.norm(x)
    return out


@pytest.mark.parametrize(("block", "kind"), [(8192, "float"), (64, "float"), (64, "double")])
def test_vector_links_equal_brute_force(spark, block, kind):
    df, rows = vectors(spark, kind=kind)
    got = sorted((tuple(r) for r in vector_join.near_vectors(df, block=block).collect()), key=str)
    unit = units(rows, kind)
    links = {i: {j for j, y in unit.items() if i != j and len(x) == len(y) and x @ y >= 0.95} for i, x in unit.items()}
    group = classes(range(len(rows)), [(a, b) for a, bs in links.items() for b in bs])
    least = {}
    for at, g in group.items():
        if rows[at][0] is not None:
            least[g] = min(least.get(g, rows[at][0]), rows[at][0])
    want = [(rows[at][0], len(links.get(at, ())), least.get(group[at]), rows[at][0] == least.get(group[at])) for at in range(len(rows))]
    assert got == sorted(want, key=str)
    assert max(map(len, links.values())) > 100
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def test_vector_cells_prune_clusters_at_every_size(spark):
    """Vectors in clusters are compared with few others, whatever the number of rows, and go to few blocks."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    for n, block in ((300, 8192), (3000, 100)):
        x = vector_join.unit(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 64)) * 0.02)
        few = int(np.ceil(np.sqrt(n)))
        c = vector_join.Cells(vector_join.farthest_first(x[: 4 * few], few))
        assert len(c.pivots) > 15
        home, far, near = c.homes(x)
        reach = np.full(len(c.pivots), -1.0)
        np.maximum.at(reach, home, far)
        c.place(reach, np.bincount(home, minlength=len(c.pivots)), block)
        assert c.parts.sum() >= 1 and sorted({*c.columns.tolist()}) == list(range(len(c.pivots)))
        sent = c.blocks_reached(near, home, np.sqrt(0.1)).sum(axis=1).mean()
        assert sent <= len(c.starts) / 4 + 1
        everyone = c.across(np.c_[near, near[np.arange(n), home]], home, np.arange(len(c.pivots)), np.sqrt(0.1))
        assert everyone.sum(axis=1).mean() < len(c.pivots) / 3, n


def test_top_k_equals_brute_force(spark, monkeypatch):
    df, rows = vectors(spark)
    q = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    q += [(50, [0, 300]), (50, [0, 300])]
    df = df.unionByName(spark.createDataFrame([(50, [0.0, 300 / 256], 1)] * 2, df.schema))
    want = []
    for at, (a, x) in enumerate(q):
        if a % 50 == 0:
            scored = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), b) for other, (b, y) in enumerate(q) if other != at)[:5]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(scored)]
    for candidates, query_bytes in ((16384, 32 << 20), (100, 600)):
        monkeypatch.setattr(topk_search, "CANDIDATES", candidates)
        monkeypatch.setattr(topk_search, "QUERY_BYTES", query_bytes)
        got = [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()]
        assert sorted(got) == sorted(want)


def test_top_k_of_few_and_equal_candidates(spark):
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (3, [1.0, 0.5]), (2, [1.0, 0.5]), (7, []), (8, [-0.001])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    own = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert own == [(2, 256 * 256 + 128 * 128), (3, 256 * 256 + 128 * 128), (50, 256 * 256 + 128 * 128), (7, 0), (8, -256)]
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0

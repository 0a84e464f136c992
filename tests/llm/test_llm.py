"""Operators for training data against brute force, a public library, or exact round trips."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelsieve.llm import bpe, canonical, clusters, mixing, spans, topn
from reelsieve.operators import components


# ---- 1 clusters


def _vectors(seed=0, groups=30, noise=0.03):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    n = 0
    for g in range(groups):
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        first = n
        for _ in range(int(rng.integers(1, 9))):
            x = (c + noise * rng.standard_normal(64)) * rng.uniform(0.1, 50)
            rows.append((n, x.tolist()))
            truth[n] = first
            n += 1
    return rows, truth


def _found(t, **options):
    r = clusters.linkage(t, "id", "v", **options).where("all_alike AND NOT alike_outside AND id <> cluster_id")
    return {(x.cluster_id, x.id) for x in r.collect()}


@pytest.mark.parametrize("options", [{}, {"component_rows": 3, "block_rows": 20}])
def test_clusters_of_cliques(spark, options):
    rows, truth = _vectors()
    bad = [(9001, None), (9002, [1.0] * 32), (9003, [0.0] * 64), (9004, [math.nan] + [1.0] * 63), (None, [1.0] * 64), rows[0]]
    t = spark.createDataFrame(rows + bad, "id bigint, v array<double>").withColumn("cell", F.lit(1))
    assert _found(t, **options) == {(f, i) for i, f in truth.items() if f != i}


def test_chains_are_no_cluster(spark):
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))] + [0.0] * 62
    t = spark.createDataFrame([(1, at(0)), (2, at(25)), (3, at(50)), (10, at(180)), (11, at(180)), (12, at(185))], "id bigint, v array<double>")
    assert _found(t) == {(10, 11), (10, 12)}
    whole = {r.id: r for r in clusters.clusters(t, "id", "v", representatives=1).collect()}
    assert whole[12].cluster_id == 10 and whole[12].cluster_size == 3 and sum(r.is_representative for r in whole.values() if r.cluster_id == 10) == 1
    assert clusters.linkage(t.where("false"), "id", "v").count() == 0


def test_rounds_are_average_linkage():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((40, 6))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = clusters.link_rounds(u, np.ones(40), 0.6)
    groups = [[i] for i in range(40)]
    while True:  # the plain algorithm: merge the best pair anywhere
        best = max(((float(np.mean([u[i] @ u[j] for i in a for j in b])), x, y) for (x, a), (y, b) in itertools.combinations(enumerate(groups), 2)), default=(0, 0, 0))
        if best[0] < 0.6:
            break
        groups[best[1]] += groups.pop(best[2])
    assert sorted(map(sorted, groups)) == sorted([sorted(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())])


def test_recall_of_links(spark):
    # pairs from 0.8 to 0.95: brute force tells which groups are alike throughout and like none outside
    rows, _ = _vectors(seed=5, groups=400, noise=0.042)
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.85
    want = set()
    for i in range(len(u)):
        group = np.flatnonzero(near[i])
        if group[0] != i and near[np.ix_(group, group)].all() and all(np.array_equal(np.flatnonzero(near[j]), group) for j in group):
            want.add((int(group[0]), i))
    got = _found(spark.createDataFrame(rows, "id bigint, v array<double>"))
    assert len(want) > 300 and len(got & want) / len(want) >= 0.99 and len(got - want) <= 0.01 * len(want)


def _chain(n=60, seed=1):
    """Rows of which each is alike to the one before and the one after only; ids in random order."""
    x = np.zeros((n, 64))
    x[0, 0] = 1
    for k in range(1, n):
        x[k] = x[k - 1] * math.cos(math.radians(25))
        x[k, k] = math.sin(math.radians(25))
    s = x @ x.T >= 0.85
    assert (s == (abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 1)).all()
    ids = np.random.default_rng(seed).permutation(n).tolist()
    return [(i, v.tolist()) for i, v in zip(ids, x)]


def test_chains_run_through_blocks(spark):
    rows = _chain()
    t = spark.createDataFrame(rows, "id bigint, v array<double>")
    # 8 pivots, all probed: every cell holds all rows and is cut alike
    links = {(r.a, r.b) for r in clusters.sparse_links(t, "id", "v", probes=8, block_rows=20).collect()}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, todo = {0}, [0]
    while todo:
        new = near.get(todo.pop(), set()) - seen
        seen |= new
        todo += new
    assert seen == set(range(len(rows)))


def test_links_across_are_brute_force():
    rng = np.random.default_rng(2)
    for threshold in (-1.0, 0.7, 0.9, 1.1):
        u = rng.standard_normal((300, 4))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        lower = rng.random(300) < 0.4
        label = np.arange(300)
        near = (u @ u.T >= threshold) & (lower[:, None] != lower[None, :])
        while (low := np.where(near, label[None, :], 300).min(axis=1, initial=300)).tolist() and (np.minimum(low, label) != label).any():
            label = np.minimum(low, label)
        a, b = clusters.links_across(np.arange(300), u, lower, threshold)
        assert dict(zip(a.tolist(), b.tolist())) == {i: int(x) for i, x in enumerate(label) if i != x}


def test_large_components_get_the_linkage_of_small_ones(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(2):
        c = rng.standard_normal(64)
        rows += [(c / np.linalg.norm(c) + 0.054 * rng.standard_normal(64)).tolist() for _ in range(40)]
    rows = [(int(i), v) for i, v in zip(rng.permutation(80), rows)]
    again = [(i, (np.array(v) + 0.01 * rng.standard_normal(64)).tolist()) for i, v in rows[:20]]  # other vectors of some ids
    t = spark.createDataFrame(rows + again, "id bigint, v array<double>")
    whole, cut = ({tuple(r) for r in clusters.linkage(t, "id", "v", component_rows=n).collect()} for n in (8192, 24))
    assert 10 < len({r[1] for r in whole}) < len(whole) and cut == whole


def _loose_groups(seed=3, groups=6, rows=50, noise=0.062):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.standard_normal(64)
        out += [(c / np.linalg.norm(c) + noise * rng.standard_normal(64)).tolist() for _ in range(rows)]
    return [(int(i), v) for i, v in zip(rng.permutation(len(out)), out)]


def test_loose_groups_are_the_same_at_any_component_size(spark):
    rows = _loose_groups()
    tight = np.ones(64) / 8
    rng = np.random.default_rng(8)
    rows += [(1000 + i, (tight + 0.01 * rng.standard_normal(64)).tolist()) for i in range(60)]  # whole within half the angle
    rows += [(2000 + i, rows[i % 7][1]) for i in range(40)]  # copies of members of a loose group
    t = spark.createDataFrame(rows, "id bigint, v array<double>")
    whole, cut = ({tuple(r) for r in clusters.linkage(t, "id", "v", component_rows=n).collect()} for n in (8192, 10))
    assert len({r[1] for r in whole}) > 7 and cut == whole
    assert {r[1] for r in whole if 1000 <= r[0] < 1060} == {1000}


def test_ties_merge_in_parallel():
    rng = np.random.default_rng(1)
    c = rng.standard_normal(64)
    copies = np.repeat((c / np.linalg.norm(c))[None, :], 5000, axis=0)
    scaled = copies[:1500] * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)  # equal but for rounding
    other = np.array([v for _, v in _loose_groups(groups=2, rows=60)])
    u = np.concatenate([copies, scaled, other])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    t = time.time()
    label, _, inside, outside = clusters.link_component(np.arange(len(u)), u, 0.85)
    assert time.time() - t < 30
    assert not label[:6500].any() and inside[:6500].all() and not outside[:6500].any()
    assert len(set(label[6500:].tolist())) > 2


def test_recall_of_cut_cells(spark):
    rows, _ = _vectors(seed=6, groups=250, noise=0.042)
    t = spark.createDataFrame(rows, "id bigint, v array<double>")
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.85)) if i < j}
    # few rows a block: every cell is cut
    links = clusters.sparse_links(t, "id", "v", block_rows=20)
    comp = {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
    kept = sum(i in comp and comp.get(i) == comp.get(j) for i, j in pairs)
    assert len(pairs) > 1000 and kept / len(pairs) >= 0.99


def test_hot_groups_are_linked_to_a_leader(spark):
    # a third of all rows alike, some at the edge of being so, some further out, and others
    rng = np.random.default_rng(9)
    c = np.zeros(64)
    c[0] = 1

    def at(deg, n):
        x = rng.standard_normal((n, 64))
        x[:, 0] = 0
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return math.cos(math.radians(deg)) * c + math.sin(math.radians(deg)) * x

    u = np.concatenate([at(2, 900), at(12, 150), at(29, 40), at(33, 40), at(36, 40), at(45, 40), at(70, 40), rng.standard_normal((1400, 64))])
    near = [u[1090 + k] + 0.05 * rng.standard_normal(64) for k in range(100)]  # like the ones further out
    u = np.concatenate([u, near])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = rng.permutation(len(u))
    t = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, u)], "id bigint, v array<double>").cache()
    # 8 pivots, all probed: every cell holds all rows
    links = clusters.sparse_links(t, "id", "v", probes=8, block_rows=200)
    hot = clusters.hot_cells(t, len(u), 8, 64, 7, 8, 0.85, 200)
    assert len(hot.leader) == 8 and all(sum(x.values()) >= 5 for x in hot.star.values())
    comp = {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
    pairs = [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(u @ u.T >= 0.85)) if i < j]
    assert all(comp.get(a, a) == comp.get(b, -1 - b) for a, b in pairs)
    # and nothing is connected that isn't, but for the rounding
    loose = components.connected_components(spark.createDataFrame([(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(u @ u.T >= 0.85 - 2 * clusters.ROUNDED)) if i < j], "a bigint, b bigint"), "a", "b")
    loose = {r.node: r.component for r in loose.collect()}
    assert all(loose.get(r.a) == loose.get(r.b) for r in links.collect())
    assert links.count() < 20 * len(u)


# ---- 4 top N


def test_top_n_is_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, None]), rng.choice([1.0, 2.0, 3.0, math.nan, None, math.inf]), rng.choice([0.5, 1.5, None]), i) for i in range(800)]
    rows += [(1000, "c", 1, 5.0, 1.0, 0)] * 3
    t = spark.createDataFrame(rows, "id int, g string, h int, s double, ts double, rank int")
    got = topn.top_n(t, 3, ["g", "h"], "s", ["ts", "id"])
    assert got.columns == t.columns
    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None and r[3] is not None and r[3] == r[3]:
            groups.setdefault((r[1], r[2]), []).append(r)
    want = [r[0] for g in groups.values() for r in sorted(g, key=lambda r: (-r[3], r[4] is None, r[4] or 0, r[0]))[:3]]
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert topn.top_n(t.where("false"), 3, ["g"], "s", ["id"]).count() == 0


def test_row_groups_are_skipped(spark):
    t = spark.range(60_000).select(F.lit("hot").alias("c0"), (F.col("id") * 7919 % 60_000).cast("double").alias("c1"), F.col("id").alias("c2"))
    path = topn.write_clustered(t.repartition(1), ["c0"], "c1")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    path = topn.write_clustered(t, ["c0"], "c1")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    seen = {}
    for f in spark.read.parquet(path).inputFiles():
        topn.read_top(f, 3, ["c0"], "c1", ["c2"], seen)
    assert seen["read"] >= 1 and seen.get("skipped", 0) >= 1


def test_files_of_a_hot_group_are_never_read(spark):
    # a third of the rows in one group, over several files; a row group is at most 8192 rows
    t = spark.range(180_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 1999).cast("string"))).alias("c0"), (F.col("id") * 7919 % 180_000).cast("double").alias("c1"), F.col("id").alias("c2"))
    path = topn.write_clustered(t, ["c0"], "c1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    every = [x for f in files.collect() for x in topn.footers(f.path, ["c0"], "c1")]
    left = {r.path: r.numbers for r in topn.worth_reading(files, 3, ["c0"], "c1").collect()}
    hot = [x for x in every if x["one"] and "hot" in x["key"]]
    read = [x for x in hot if x["number"] in left.get(x["path"], [])]
    assert len(hot) >= 5 and len(read) <= 2 and all(x["number"] in left[x["path"]] for x in every if not x["one"])
    got = {(r.c0, r.c2) for r in topn.top_n(t, 3, ["c0"], "c1", ["c2"]).collect()}
    best = {}
    for r in t.collect():
        best.setdefault(r.c0, []).append((-r.c1, r.c2))
    assert got == {(g, i) for g, x in best.items() for _, i in sorted(x)[:3]}


def test_latest(spark):
    t = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, None, "c"), (2, 1, "d"), (None, 1, "e")], "k int, at int, x string")
    assert {(r.k, r.x) for r in topn.latest(t, "k", "at").collect()} == {(1, "b"), (2, "d"), (None, "e")}


# ---- 5 canonical values


def test_canonical(spark):
    entries = spark.createDataFrame([(1, "brand", "Brogindo Bank", ["Brogindo", "BOIB"]), (2, "brand", "Multiduvo", None), (3, "brand", "Mulieduvu", []), (4, "industry", "Garden tools and seeds", ["gardening"])], "entry_id int, list_name string, entry_name string, also_known_as array<string>")
    cases = {"brogindo": 1, "B R O G I N D O": 1, '"BROGNIDO bank" ': 1, "#BrogindoBank": 1, "by Brogindo Bank, Ltd": 1, "Bank Brogindo": 1, "boib": 1, "Brógindo™": 1, "mutliduvo": 2, "Br0gindo": 1, "multiduvo": 2, "MULIEDUVU!": 3, "Zeganora Home": 0, "n/a": 0, "-": 0, "unknown": 0, "x" * 5000: 0}
    values = [("brand", v) for v in cases] + [("industry", "seeds & garden tool"), ("industry", "GARDENTOOLSANDSEEDS"), ("industry", "gardn tols and seeds (retail)"), ("industry", "Falconry"), ("other", "Brogindo"), ("brand", None), ("brand", " \t"), ("brand", "brogindo")]
    got = {(r.list_name, r.value): r.entry_id for r in canonical.map_values(spark.createDataFrame(values, "list_name string, value string"), entries).collect()}
    assert got == {**{("brand", v): e for v, e in cases.items()}, ("industry", "seeds & garden tool"): 4, ("industry", "GARDENTOOLSANDSEEDS"): 4, ("industry", "gardn tols and seeds (retail)"): 4, ("industry", "Falconry"): 0, ("other", "Brogindo"): 0}
    assert canonical.map_values(spark.createDataFrame(values, "list_name string, value string").where("false"), entries).count() == 0


def test_parts_and_slices_dont_show(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bdklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(3, 6)))
    names = sorted({word() for _ in range(150)})
    entries = spark.createDataFrame([(i, "brand", n, []) for i, n in enumerate(names, 1)], "entry_id int, list_name string, entry_name string, also_known_as array<string>")

    def typo(x):
        k = rng.randrange(1, len(x) - 1)
        return rng.choice([x[:k] + x[k + 1 :], x[:k] + x[k + 1] + x[k] + x[k + 2 :], x[:k] + "q" + x[k:], x.upper()])

    values = spark.createDataFrame([("brand", typo(n)) for n in names for _ in range(3)], "list_name string, value string")
    whole, cut = ({tuple(r) for r in canonical.map_values(values, entries, **o).collect()} for o in ({}, {"part_names": 40, "slice_values": 50}))
    assert whole == cut and sum(r[2] > 0 for r in whole) > 0.9 * len(whole)


def test_candidates_are_brute_force():
    rng = random.Random(3)
    forms = [("".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))), i) for i in range(120)]
    weight = {g: rng.uniform(0.5, 2) for f, _ in forms for g in canonical.grams(f)}
    index = canonical.Index(forms, weight, 2.0)
    tried = [f[1:] + "a" for f, _ in forms[:40]] + ["zzz"]
    for form, (names, scores) in zip(tried, index.candidates(tried)):
        v = index._vector(form)
        want = {k: s for k, (f, _) in enumerate(index.forms) if (s := sum(v.get(g, 0) * x for g, x in index._vector(f).items())) >= canonical.THRESHOLD}
        assert dict(zip(names.tolist(), np.round(scores, 9).tolist())) == {k: round(s, 9) for k, s in want.items()}


def test_edits():
    assert [canonical.edits(a, b, 3) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyzabc"), ("abc", "vwxyz"))] == [0, 1, 1, 3, 4]


# ---- 7 tokens


def test_ids_are_the_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    ref.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["", None, " ", "<|endoftext|>", "aaaa aaaaa   x\x1c\x85y", "don't we'll  \n\n x", "　 ​﻿ é \U0001d518", "word " * 40_000, "z" * 3000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x300, 0xD7FF), rng.randrange(0xE000, 0x10FFFF), 32, 10, 39])) for _ in range(rng.randrange(30))) for _ in range(400)]
    t = spark.createDataFrame(list(enumerate(texts)) + [(0, "")], "id int, text string").withColumn("ids", F.lit("clash"))
    want = {i: ref.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    got = bpe.encode(t, "id", "text").collect()
    assert len(got) == len(texts) + 1 and all(list(r.ids) == want[r.id] for r in got)
    assert {r.id: r.n_tokens for r in bpe.encode(t, "id", "text", counts_only=True).collect()} == {i: len(x) for i, x in want.items()}
    v = bpe.vocabulary(bpe.VOCABULARY)
    assert all(v.decode(want[i]) == (x or "") for i, x in enumerate(texts))
    assert bpe.encode(t.where("false"), "id", "text").count() == 0


# ---- 8 mixing


def test_rates():
    have = {"a": 100, "b": 50, "c": 0}
    assert mixing.plan_rates(have, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 1, "b": 2, "c": 9}) == pytest.approx({"a": 1.0, "b": 1.0})
    assert mixing.plan_rates(have, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 140) == pytest.approx({"a": 0.9, "b": 1.0})
    assert mixing.plan_rates({}, {"a": 1.0}, {"a": 1}) == {}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "hot", "small", "other", None]), rng.randrange(0, 60)) for i in range(3000)]
    t = spark.createDataFrame(rows + rows[:5], "doc_id bigint, source string, n_tokens bigint")
    goal = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(t, goal)
    d = drawn.collect()
    assert max(r.copies for r in d if r.source == "hot") <= 1 and max(r.copies for r in d if r.source == "small") <= 3 and all(r.n_tokens > 0 for r in d)
    assert {r.source for r in d} == {"hot", "small"} and len({r.doc_id for r in d}) == len(d)
    again = mixing.draw(t.repartition(3), goal).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, d))
    shares = {r.source: r.share_reached for r in mixing.report(t, goal, drawn).collect()}
    assert abs(shares["hot"] - 0.5) < 0.02 and shares["absent"] == 0 and None in shares
    assert mixing.draw(t.where("false"), goal).count() == 0
    # systematic sampling: a source's total number of copies is its expectation, rounded
    ones = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(1).cast("bigint").alias("n_tokens"))
    total = mixing.draw(ones, goal.where("source = 'hot'"), total_tokens=333).agg(F.sum("copies")).first()[0]
    assert total in (333, 334)


def test_tokens_of_the_mix_reach_the_planned_shares(spark):
    rng = np.random.default_rng(2)
    # sizes from a few tokens to thousands; the poor source can't reach its share and doesn't shrink the mix
    size = lambda n: np.exp(rng.uniform(1, 9, n)).astype(int)
    rows = [(i, s, int(n)) for i, (s, n) in enumerate([(s, n) for s, k in (("a", 900), ("b", 400), ("poor", 2)) for n in size(k)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    goal = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 5), ("poor", 0.1, 3)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(docs, goal).cache()
    r = {x.source: x for x in mixing.report(docs, goal, drawn).collect()}
    assert r["poor"].at_cap and r["poor"].most_copies == 3 and not r["a"].at_cap
    for s in "ab":
        assert abs(r[s].share_reached / r[s].share_planned - 1) < 0.01
    assert abs(sum(x.tokens_drawn for x in r.values()) / sum(n for *_, n in rows) - 1) < 0.01


# ---- 9 spans


def _pairs(texts, length):
    seen = {}
    for i, t in texts:
        for k in range(len(t or "") - length + 1):
            seen.setdefault(t[k : k + length], set()).add(i)
    return {p for s in seen.values() for p in itertools.combinations(sorted(s), 2)}, seen


def _texts(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé \n漢\U0001d518") for _ in range(n))
    parts = [word(rng.randrange(30, 60)) for _ in range(6)]
    texts = []
    for i in range(60):
        t = "".join(rng.choice([word(rng.randrange(5, 40)), rng.choice(parts), rng.choice(parts)[: rng.randrange(25, 35)]]) for _ in range(rng.randrange(1, 6)))
        texts.append((i, t))
    texts += [(100, texts[0][1]), (101, texts[0][1]), (102, "a" * 90), (103, "b" + "a" * 45), (104, None), (105, ""), (106, "x" * 29)]
    return texts


@pytest.mark.parametrize("hot_rows", [20_000, 2])
def test_shared_spans_are_brute_force(spark, hot_rows):
    texts = _texts(9)
    t = spark.createDataFrame(texts + texts[:2], "id bigint, text string").withColumn("doc", F.lit(1)).withColumn("h", F.lit(2))
    want, windows = _pairs(texts, 30)
    got = {tuple(r) for r in spans.shared_pairs(t, "id", "text", 30, 12, hot_rows).collect()}
    assert got == want
    cover = {r.doc: r.shared_chars for r in spans.coverage(t, "id", "text", 30, 12, hot_rows).collect()}
    for i, x in texts:
        x = x or ""
        inside = set()
        for k in range(len(x) - 29):
            if len(windows[x[k : k + 30]]) > 1:
                inside |= set(range(k, k + 30))
        assert cover[i] == len(inside), i
    assert spans.shared_pairs(t.where("false"), "id", "text").count() == 0


def test_factors_are_greedy_and_refer_to_equal_text(spark):
    texts = dict(_texts(11))
    t = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    docs = spans._documents(t, "id", "text", 30)
    rows = [r for r in spans.factors(docs, 30, 12).collect() if r.kind == "span"]
    assert len(rows) > 50
    for r in rows:
        own, other = texts[r.doc][r.start : r.stop], texts[r.ref_doc][r.ref_start : r.ref_start + r.stop - r.start]
        assert own == other and len(own) >= 30 and r.doc != r.ref_doc
    sets = [r for r in spans.factors(docs, 30, 12).collect() if r.kind == "set"]
    assert {texts[r.ref_doc][r.ref_start : r.ref_start + 30] in texts[r.doc] for r in sets} == {True}


@pytest.mark.parametrize("hot_rows", [20_000, 5])
def test_texts_that_repeat_a_pattern(spark, hot_rows):
    texts = [(1, "ab" * 300), (2, "xyz" + "ab" * 40 + "q" * 100 + "ab" * 30), (3, "c" * 700 + "d" + "c" * 31), (4, "c" * 45), (5, ("word " * 9 + ".") * 12), (6, "word " * 9 + ". other")]
    t = spark.createDataFrame(texts, "id bigint, text string")
    want, windows = _pairs(texts, 30)
    assert {tuple(r) for r in spans.shared_pairs(t, "id", "text", 30, 12, hot_rows).collect()} == want
    cover = {r.doc: r.shared_chars for r in spans.coverage(t, "id", "text", 30, 12, hot_rows).collect()}
    for i, x in texts:
        inside = set()
        for k in range(len(x) - 29):
            if len(windows[x[k : k + 30]]) > 1:
                inside |= set(range(k, k + 30))
        assert cover[i] == len(inside), i


def test_longest_match_of_a_block():
    texts = [(1, "abcdefgh12345678zz"), (2, "xxcdefgh12345678zzq"), (2, "xxxdefgh1234567yyyy"), (3, "abcdefgh1234WWWW")]
    batch = pa.RecordBatch.from_pydict({"h": [7] * 4, "doc": [d for d, _ in texts], "place": [4] * 4, "run": [0] * 4, "lead": pa.array([4] * 4, pa.int32()), "context": [t for _, t in texts]})
    found = spans.parse(spans.Block([batch], 8), spans.Rolling())
    got = {tuple(r[k] for k in ("doc", "start", "stop", "ref_doc", "ref_start")) for r in found.to_pylist() if r["kind"] == "span"}
    # text 1 from its first window with text 3; the window from 5 on, at the boundary, holds another anchor
    assert got == {(1, 0, 12, 3, 0), (3, 0, 12, 1, 0), (2, 2, 18, 1, 2), (2, 3, 15, 1, 3)}


def test_one_anchor_in_very_many_places(spark):
    phrase = "the same words in every text, " * 5
    t = spark.range(120_000).select("id", F.concat(F.md5(F.col("id").cast("string")), F.lit(phrase[:136]), F.md5((F.col("id") + 7).cast("string"))).alias("text"))
    t = t.unionAll(t.where("id < 3").select(F.col("id") + 1_000_000, "text"))
    assert {tuple(r) for r in spans.shared_pairs(t, "id", "text").collect()} == {(i, i + 1_000_000) for i in range(3)}
    cover = spans.coverage(t, "id", "text")
    assert cover.agg(F.sum("shared_chars")).first()[0] == 6 * 200


def test_queries_run(spark, small):
    from compare import rows, views
    from reelsieve.llm import queries

    df = queries.QUERIES["p4_found"](spark, small)
    r = views(small).sql(queries.SQL["p4_found"])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(r.columns, r.fetchall())
    for name in ("p1_clusters", "p5_found", "p5_unmatched", "p7_tokens_by_source", "p8_report", "p9_found"):
        assert queries.QUERIES[name](spark, small).count() > 0

"""Frame selection against a plain walk over each video in Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsieve.operators import selection as S
from reelsieve.operators.group_models import kmeans_group, kmeans_labels
from reelsieve.operators.joins import band_factors, first_match


def _video(seed, n=60, scenes=5, width=8):
    rng = np.random.default_rng(seed)
    ts = np.sort(np.round(rng.uniform(0, 40, n), 2))
    ts[3] = ts[4]
    base = rng.standard_normal((4, width))
    v = base[rng.integers(0, 4, n)] + 0.25 * rng.standard_normal((n, width))
    bounds = [(i, 8.0 * i, 8.0 * i + 7) for i in range(scenes) if i != 2]
    return [(int(i), "v", float(t), float(s), x.tolist()) for i, t, s, x in zip(range(n), ts, np.round(rng.uniform(0.5, 2, n), 3), v)], bounds


def _plain(rows, bounds, method, budget):
    """The selection one frame after the other."""
    rows = [{"id": i, "ts": t, "imp": s, "v": np.array(x), "u": np.array(x) / np.linalg.norm(x)} for i, _, t, s, x in sorted(rows, key=lambda r: (r[2], r[0]))]
    dur = max([r["ts"] for r in rows] + [e for *_, e in bounds])
    for r in rows:
        held = [k for k, a, b in bounds if a <= r["ts"] < b]
        r["scene"] = min(held) if held else min((min(abs(r["ts"] - a), abs(r["ts"] - b)), k) for k, a, b in bounds)[1]
        a, b = next((a, b) for k, a, b in bounds if k == r["scene"])
        p, q = r["ts"] / dur, (r["ts"] - a) / (b - a)
        r["imp"] *= (1.5 if p < 0.1 else 1.4 if p > 0.9 else 1.1 if 0.4 < p < 0.6 else 1.0) * (1.4 if q < 0.15 else 1.2 if q > 0.85 else 1.0)
    first, last = rows[0]["ts"], rows[-1]["ts"]
    rows[0]["imp"] *= 2.0
    next(r for r in rows if r["ts"] == last)["imp"] *= 1.8
    out = []
    for scene in sorted({r["scene"] for r in rows}):
        own = [r for r in rows if r["scene"] == scene]
        step = own if len(own) <= 10 else own[:: len(own) // 10]
        variance = np.mean([np.abs(x["u"] - y["u"]).mean() for x, y in zip(step, step[1:])]) if len(step) > 1 else 0
        d = 0.25
        if len(own) >= 2:
            d *= (1.3 if variance > 0.15 else 0.7 if variance < 0.05 else 1.0) * (1.2 if max(r["imp"] for r in own) > 1.5 else 1.0)
        n = max(2, min(max(1, int(max(own[-1]["ts"] - own[0]["ts"], 0.1) * d)), 10, len(own)))
        forced = [r for r in own if r["ts"] in (first, last)]
        rest = [r for r in own if r["ts"] not in (first, last)]
        if len(own) <= n:
            out += own
            continue
        kept = list(forced)
        if method == "nms":
            bonus = lambda r: 0.1 * (1 - min([1.0] + [float(r["u"] @ f["u"]) for f in forced])) if forced else 0.0
            for r in sorted(rest, key=lambda r: -(r["imp"] + bonus(r))):
                if len(kept) >= n:
                    break
                if all(abs(r["ts"] - k["ts"]) >= 0.5 and r["u"] @ k["u"] <= 0.88 * (1 + 0.3 * (1 - math.exp(-abs(r["ts"] - k["ts"]) / 5))) for k in kept):
                    kept.append(r)
        elif n > len(forced):
            m = min(n - len(forced), len(rest))
            if method == "uniform":
                size = len(rest) / m
                kept += [max(part, key=lambda r: r["imp"]) for i in range(m) if (part := rest[int(i * size) : int((i + 1) * size)])]
            else:
                rest.sort(key=lambda r: r["id"])
                label, far = kmeans_group(np.array([r["v"] for r in rest]), m)
                for c in set(label.tolist()):
                    own_c = [(r, f) for r, f, k in zip(rest, far, label) if k == c]
                    most = max(f for _, f in own_c) or 1.0
                    kept.append(max(own_c, key=lambda x: (round(0.6 * x[0]["imp"] + 0.4 * (1 - x[1] / most), 9), -x[0]["ts"], -x[0]["id"]))[0])
        out += kept
    one = {}
    for r in sorted(out, key=lambda r: (r["scene"], r["id"])):
        one.setdefault(r["ts"], r)
    u = np.array([r["u"] for r in rows])
    steps = np.linalg.norm(np.diff(u, axis=0), axis=1).mean()
    base = max(5, len(bounds) + 1)
    s = np.linalg.svd(u - u.mean(axis=0), compute_uv=False) ** 2
    isd = int(np.argmax(np.cumsum(s / (s.sum() + 1e-9)) >= 0.9)) + 1
    allowed = min(int(base + 1.5 * isd), max(base, int(base + dur * 0.25 * max(0.2, 2.5 * steps) * np.mean([r["imp"] for r in rows])))) if budget == "information" else min(max(5, int(dur * 0.25)), 25)
    best = sorted(one.values(), key=lambda r: (-r["imp"], r["ts"], r["id"]))[:allowed]
    return {r["id"] for r in best}


def _tables(spark, rows, bounds):
    c = spark.createDataFrame(rows, "candidate_id bigint, video_id string, ts double, importance_score double, embedding array<double>")
    return c, spark.createDataFrame([("v", *b) for b in bounds], "video_id string, scene_id int, start_s double, end_s double")


@pytest.mark.parametrize("method,budget", [("nms", "information"), ("uniform", "static"), ("no such method", "information"), ("kmeans", "static")])
def test_selection_is_the_plain_one(spark, method, budget):
    for seed in (1, 2):
        rows, bounds = _video(seed)
        c, s = _tables(spark, rows, bounds)
        got = {r.candidate_id for r in S.select_frames(c, s, method=method, budget=budget).collect()}
        assert got == _plain(rows, bounds, method if method in S.METHODS else "uniform", budget) and len(got) > 5


def test_hybrid_covers_clusters(spark):
    rows, bounds = _video(4)
    c, s = _tables(spark, rows, bounds)
    nms, mixed = ({r.candidate_id for r in S.select_frames(c, s, method=m, budget="static").collect()} for m in ("nms", "hybrid"))
    ends = {min(rows, key=lambda r: (r[2], r[0]))[0], max(rows, key=lambda r: (r[2], -r[0]))[0]}
    assert ends <= nms and ends <= mixed and abs(len(nms) - len(mixed)) <= 2
    assert {r.candidate_id for r in S.select_frames(c.where("false"), s, method="hybrid").collect()} == set()


def test_budget_follows_the_dimension(spark):
    rng = np.random.default_rng(0)
    scene = lambda n: [(i, 6.0 * i, 6.0 * i + 6) for i in range(n)]
    same = [(i, "v", float(i), 1.0, (np.ones(64) + (np.arange(64) == 0) * 1e-3 * rng.standard_normal()).tolist()) for i in range(30)]
    wild = [(i, "v", float(i), 2.0, rng.standard_normal(64).tolist()) for i in range(30)]
    numbers = {}
    for name, rows, n in (("same", same, 2), ("wild", wild, 5)):
        c, s = _tables(spark, rows, scene(n))
        v = c.select("candidate_id", F.col("embedding").alias("v"))
        numbers[name] = S.budgets(S.scored(c.drop("embedding"), s), v, density=1.0).first()
    assert numbers["same"].budget <= 8 and numbers["same"].dimension <= 2
    assert numbers["wild"].budget >= 25 and numbers["wild"].dimension > 10


def test_numbers_dont_depend_on_stretches(spark):
    rows, bounds = _video(9)
    c, s = _tables(spark, rows, bounds)
    v = c.select("candidate_id", F.col("embedding").alias("v"))
    placed = S.scored(c.drop("embedding"), s)
    a, b = (S.video_numbers(placed, v, stretch=x).first() for x in (600.0, 3.0))
    assert (a.n, a.dimension) == (b.n, b.dimension) and abs(a.mean_step - b.mean_step) < 1e-12


def test_videos_without_scenes_and_single_frames(spark):
    rows = [(1, "a", 3.0, 1.0, [1.0, 0.0]), (2, "b", 0.0, 1.0, [1.0, 0.0]), (3, "b", 0.0, 2.0, [0.0, 1.0])]
    c, s = _tables(spark, rows, [])
    got = {(r.candidate_id, r.scene, round(r.imp, 6)) for r in S.select_frames(c, s).collect()}
    assert got == {(1, 0, 5.04), (2, 0, 3.6)}


def test_large_groups_get_the_labels_of_small_ones(spark):
    rng = np.random.default_rng(5)
    rows = [("g" if i % 3 else "h", i, rng.standard_normal(6).tolist(), 4 if i % 3 else 3) for i in range(90)]
    t = spark.createDataFrame(rows, "key string, row bigint, v array<double>, k int")
    whole, cut = ({(r.key, r.row, r.cluster, round(r.far, 6)) for r in kmeans_labels(t, "key", "row", "v", 5, 6, n).collect()} for n in (1000, 10))
    assert whole == cut and len({(k, c) for k, _, c, _ in whole}) == 7


def test_nearest_bounds_are_brute_force(spark):
    rng = random.Random(3)
    scenes = [("v", i, float(a), float(a + rng.choice([1, 2]))) for i, a in enumerate(rng.sample(range(0, 60, 3), 12))] + [("v", 90, None, 5.0), ("w", 1, 4.0, None)]
    points = [(i, rng.choice(["v", "v", "w", "x", None]), rng.choice([rng.uniform(-5, 70), float(rng.randrange(70)), None])) for i in range(300)]
    p = spark.createDataFrame(points, "id bigint, video string, ts double")
    s = spark.createDataFrame(scenes, "video string, scene int, a double, b double")
    got = {r.id: r.scene for r in first_match(p, s, ["video"], "id", "ts", "a", "b", "scene", 8.0).collect()}
    whole = [x for x in scenes if x[2] is not None and x[3] is not None]
    for i, v, t in points:
        own = [x for x in whole if x[0] == v] if t is not None else []
        held = [x[1] for x in own if x[2] <= t < x[3]]
        assert got[i] == (min(held) if held else min((min(abs(t - x[2]), abs(t - x[3])), x[1]) for x in own)[1] if own else None)


def test_sounds_near_a_point(spark):
    sounds = [("v", "peak", 1.5, None, 0), ("v", "silence", 2.0, 2.5, 0), ("v", "speech", 7.0, 9.0, 1), ("v", "speech", 8.8, 12.0, 2), ("v", "phrase", None, 20.0, 0), ("v", "phrase", 30.0, None, 0), ("v", "phrase", None, None, 0), ("v", None, 1.0, 1.0, 0)]
    a = spark.createDataFrame(sounds, "video_id string, kind string, start double, end double, ord int")
    at = {1: 1.5, 2: 2.5, 3: 3.0, 4: 2.99, 5: 7.3, 6: 9.0, 7: 12.2, 8: 20.4, 9: 30.4, 10: 0.1, 11: 15.0, 12: 2.0}
    p = spark.createDataFrame([(i, "v", t) for i, t in at.items()] + [(13, None, 1.5), (14, "v", None)], "id int, video_id string, ts double")
    got = {r.id: round(r.sound, 6) for r in band_factors(p, a, "id", "video_id", "ts", 0.5).collect()}
    assert got == {1: 1.3, 2: 1.4, 4: 1.4, 5: 1.2, 6: 1.15, 7: 1.15, 8: 1.5, 9: 1.5, 10: 1.5}

"""Nearest neighbours against brute force, with vectors that take no part, ties and copies."""

import math
import random

import numpy as np

from granary.llm import neighbours


def exact(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(v, good.get(i, v))
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted((-float(np.dot(np.float64(good[q]), np.float64(v))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = near[:k]
    return out


def test_nearest(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(900)]
    rows += [(2000 + i, rows[3][1]) for i in range(60)]  # copies: ties go by id
    rows += [(3001, None), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [None] + [1.0] * 7), (3005, [math.inf] + [1.0] * 7), (3006, []), (None, [1.0] * 8), (20, rows[20][1])]
    rows += [(4000 + i, [1.0, float(i)]) for i in range(3)]  # of another length
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, shard string, label int")
    got = {}
    for r in neighbours.nearest(df, 20, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows, 20, 20)
    assert got.keys() == {q for q in want if want[q]}
    hit = total = 0
    for q, near in want.items():
        found = sorted(got.get(q, []))
        assert [r for r, *_ in found] == list(range(1, len(near) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in near})
        total += len(near)
    assert hit / total >= 0.95
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_recall_at_any_norm(spark):
    """Normal and log-normal norms, an outlier among unit vectors, components beyond single precision, a sole huge pair."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    outlier = unit.copy()
    outlier[7] *= 1e4
    for v in (x, unit * np.exp(rng.normal(size=(1500, 1)) * 0.5), outlier, unit * 1e20, unit * 1e-25, np.concatenate([unit[:1400], unit[1400:] * 1e200])):
        rows = [(i, v[i].tolist()) for i in range(len(v))]
        got = {}
        for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
            got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
        asked = np.arange(0, len(v), 20)
        with np.errstate(over="ignore", invalid="ignore"):
            score = v[asked] @ (v / np.abs(v).max()).T
        score[np.arange(len(asked)), asked] = -np.inf
        hit = sum(len(set(np.argsort(-s)[:20].tolist()) & set(got[q])) for q, s in zip(asked.tolist(), score))
        assert all(len(got[q]) == 20 for q in asked.tolist())
        assert hit >= 0.95 * 20 * len(asked)


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 150)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want = {q: {i for _, i in near} for q, near in exact(rows, 20, 20).items()}
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))

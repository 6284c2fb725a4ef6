"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Vectors of about one length (norm) form the shards of a band, so that within a shard the largest
inner products are nearly the least distances; one further component makes that exact, and
scales of any size are divided out.  Vectors join a shard's graph in growing blocks: a greedy
beam search from the medoid proposes neighbours, pruning relaxed by ALPHA keeps those that no
kept one is nearer to, edges are added backwards and pruned again.  All queries search every
shard by beam search; found ones are scored in double precision on the original vectors.
Equal vectors are one node, with as many ids as a result can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import keep, table

#: Distinct vectors in a shard, edges of a node, beam widths to build and to search, relaxation.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 16384, 32, 64, 192, 1.2
#: Bands of norms to a doubling: there are about 17,000 at most in all of double precision.
OCTAVE = 8
#: Queries that search a shard at a time, as one task.
QUERY_BLOCK = 8192
_STEP = 4


def beam_search(x, graph, entry: int, queries, beam: int):
    """The `beam` nearest found for each query (inner product, larger is nearer), nearest first: ids, -1 for none."""
    import numpy as np

    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1, dtype=np.int64)
    score = np.full((b, beam), -np.inf, dtype=np.float32)
    done = np.ones((b, beam), dtype=bool)
    met = np.zeros((b, n), dtype=bool)
    ids[:, 0], score[:, 0], done[:, 0] = entry, queries @ x[entry], False
    met[:, entry] = True
    rows = np.arange(b)
    while True:
        open_ = np.where(done, -np.inf, score)
        active = np.flatnonzero(np.isfinite(open_).any(axis=1))
        if not len(active):
            return ids
        k = min(_STEP, beam)
        pick = np.argpartition(-open_[active], k - 1, axis=1)[:, :k] if k < beam else np.tile(np.arange(beam), (len(active), 1))
        chosen = np.isfinite(np.take_along_axis(open_[active], pick, axis=1))
        r, c = np.nonzero(chosen)
        done[active[r], pick[r, c]] = True
        near = np.full((len(active), k, graph.shape[1]), -1, dtype=np.int64)
        near[r, c] = graph[ids[active[r], pick[r, c]]]
        near = near.reshape(len(active), -1)
        # New ones only, each once.
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~met[active[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        met[active[r], near[r, c]] = True
        got = np.full(near.shape, -np.inf, dtype=np.float32)
        got[r, c] = np.einsum("ij,ij->i", queries[active[r]], x[near[r, c]])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_score = np.concatenate([score[active], got], axis=1)
        all_done = np.concatenate([done[active], np.zeros_like(fresh)], axis=1)
        top = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        ids[active], score[active] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_score, top, 1)
        dead = ~np.isfinite(score[active])
        done[active] = np.take_along_axis(all_done, top, 1) | dead
        ids[active] = np.where(dead, -1, ids[active])
    return rows


def prune(x, nodes, candidates, degree: int, alpha: float):
    """Of each node's candidates (-1 for none), up to `degree` diverse ones: the nearest, then those not nearer to a kept one."""
    import numpy as np

    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    c = np.sort(candidates, axis=1)
    live = c >= 0
    live[:, 1:] &= c[:, 1:] != c[:, :-1]
    live &= c != nodes[:, None]
    v = x[np.maximum(c, 0)]
    norm = np.einsum("bkd,bkd->bk", v, v)
    own = x[nodes]
    far = np.maximum(norm + np.einsum("bd,bd->b", own, own)[:, None] - 2 * np.einsum("bd,bkd->bk", own, v), 0)
    far = np.where(live, far, np.inf)
    between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    rows = np.arange(len(nodes))
    left = far.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        out[ok, k] = c[rows[ok], best[ok]]
        left[rows, best] = np.inf
        left[alpha * alpha * between[rows, best] <= far] = np.inf
    return out


def build(x, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
    """x (distinct vectors, float32, Euclidean) -> (graph of neighbour ids, -1 for none, and the entry)."""
    import numpy as np

    n = len(x)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    unit = np.concatenate([x, (x * x).sum(axis=1, keepdims=True)], axis=1)  # distance as an inner product
    at = 1
    while at < n:
        block = order[at : at + max(1, min(512, at))]
        q = np.concatenate([2 * x[block], -np.ones((len(block), 1), dtype=np.float32)], axis=1)
        found = beam_search(unit, graph, entry, q, beam)
        # Members of one block see each other as well, so that near twins are linked.
        peers = (2 * x[block] @ x[block].T) - (x[block] ** 2).sum(axis=1)[None, :]
        np.fill_diagonal(peers, -np.inf)
        m = min(8, len(block) - 1)
        if m:
            found = np.concatenate([found, block[np.argpartition(-peers, m - 1, axis=1)[:, :m]]], axis=1)
        graph[block] = prune(x, block, found, degree, alpha)
        # Backwards: what each target has, and those that now point to it.
        src = np.repeat(block, degree)
        dst = graph[block].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.empty(0, dtype=np.int64)
        size = np.diff(np.concatenate([first, [len(dst)]]))
        for lo in range(0, len(first), 512):
            f, s = first[lo : lo + 512], size[lo : lo + 512]
            targets = dst[f]
            new = np.full((len(f), int(s.max())), -1, dtype=np.int64)
            r = np.repeat(np.arange(len(f)), s)
            k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            new[r, k] = src[np.repeat(f, s) + k]
            both = np.concatenate([graph[targets], new], axis=1)
            room = (both >= 0).sum(axis=1) <= degree
            packed = -np.sort(-both, axis=1)[:, :degree]
            graph[targets[room]] = packed[room]
            # An unusually wide row is pruned by itself, piece by piece.
            for i in np.flatnonzero(~room) if both.shape[1] > 256 else ():
                have = both[i][both[i] >= 0]
                while len(have) > degree:
                    have = np.concatenate([p[p >= 0] for p in (prune(x, targets[i : i + 1], have[None, j : j + 256], degree, alpha)[0] for j in range(0, len(have), 256))])
                    if len(have) <= 256:
                        have = prune(x, targets[i : i + 1], have[None], degree, alpha)[0]
                        have = have[have >= 0]
                graph[targets[i]] = np.concatenate([have, np.full(degree - len(have), -1)])
            if both.shape[1] <= 256 and (~room).any():
                graph[targets[~room]] = prune(x, targets[~room], both[~room], degree, alpha)
        at += len(block)
    return graph, entry


def _augmented(v):
    """Inner products with (query, 0) order the vectors as before; all are of length one."""
    import numpy as np

    v = v / np.abs(v).max()
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v = v / norm.max()
    return np.concatenate([v, np.sqrt(np.maximum(1 - (norm / norm.max()) ** 2, 0))[:, None]], axis=1).astype(np.float32)


def _directions(q):
    """Queries of length one, with a further component of zero."""
    import numpy as np

    q = q / np.abs(q).max(axis=1, keepdims=True)
    q = q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)


def scores(a, b):
    """Inner products of rows in double precision; where parts overflow, that of rows scaled by powers of two."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", a, b)
        odd = np.flatnonzero(~np.isfinite(out))
        if len(odd):
            ea, eb = (np.frexp(np.abs(x[odd]).max(axis=1))[1] for x in (a, b))
            small = np.einsum("ij,ij->i", np.ldexp(a[odd], -ea[:, None]), np.ldexp(b[odd], -eb[:, None]))
            out[odd] = np.ldexp(small, ea + eb)
    return out


def _index(shard):
    import numpy as np
    import pyarrow as pa

    v = np.stack(shard.column("embedding").to_numpy())
    graph, entry = build(_augmented(v.astype(np.float64)))
    flat = pa.array([graph.astype("<i4").tobytes()], pa.binary())
    ids = shard.column("vec_ids").to_pylist()
    return pa.table({"width": shard.column("width")[:1], "shard": shard.column("shard")[:1], "entry": pa.array([entry], pa.int32()), "vectors": pa.array([v.astype("<f8").tobytes()], pa.binary()), "graph": flat, "vec_ids": pa.array([ids], pa.list_(pa.list_(pa.int64())))})


def _search(index, queries, k: int, beam: int):
    """The k nearest ids of a shard for each of some queries: query_id, vec_id, score."""
    import numpy as np
    import pyarrow as pa

    out = {"query_id": [], "vec_id": [], "score": []}
    types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    if index.num_rows and queries.num_rows:
        ids = index.column("vec_ids")[0].as_py()
        v = np.frombuffer(index.column("vectors")[0].as_py(), dtype="<f8").reshape(len(ids), -1)
        graph = np.frombuffer(index.column("graph")[0].as_py(), dtype="<i4").reshape(len(ids), -1).astype(np.int64)
        x, entry = _augmented(v), index.column("entry")[0].as_py()
        q_ids = queries.column("vec_id").to_numpy()
        q = np.stack(queries.column("embedding").to_numpy()).astype(np.float64)
        size = np.array([len(i) for i in ids])
        flat = np.array([j for i in ids for j in i], dtype=np.int64)
        start = np.cumsum(size) - size
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            found = beam_search(x, graph, entry, _directions(part), min(beam, len(ids)))
            # A shard that holds few enough is searched whole: nothing that can be returned is left out.
            if len(ids) <= beam:
                found = np.tile(np.arange(len(ids)), (len(part), 1))
            r, c = np.nonzero(found >= 0)
            node = found[r, c]
            score = scores(part[r], v[node])
            r2, s2 = np.repeat(r, size[node]), np.repeat(score, size[node])
            vec = flat[np.repeat(start[node] - (np.cumsum(size[node]) - size[node]), size[node]) + np.arange(size[node].sum())]
            other = vec != q_ids[lo + r2]
            r2, s2, vec = r2[other], s2[other], vec[other]
            order = np.lexsort((vec, -s2, r2))
            r2, s2, vec = r2[order], s2[order], vec[order]
            place = np.arange(len(r2)) - np.searchsorted(r2, r2)
            top = place < k
            out["query_id"].append(q_ids[lo + r2[top]])
            out["vec_id"].append(vec[top])
            out["score"].append(s2[top])
    return pa.table({c: pa.array(np.concatenate(a) if a else [], types[c]) for c, a in out.items()})


def band(embedding: Column) -> Column:
    """The band of a vector's norm: OCTAVE times its binary logarithm, found without overflow."""
    most = F.array_max(F.transform(embedding, lambda e: F.abs(e)))
    squares = F.aggregate(F.transform(embedding, lambda e: (e / most) * (e / most)), F.lit(0.0), lambda a, b: a + b)
    return F.floor(OCTAVE * (F.log2(most) + F.log2(squares) / 2) + 0.5).cast("int")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    Nearness is the inner product; candidates are all rows but those with the query's vec_id;
    equal scores go by smaller vec_id.  Rows with a null vec_id, and vectors that are null,
    empty, zero or hold null or non-finite components take no part; of rows with one vec_id the
    least vector counts; vectors are compared with those of their own length.  An empty table
    gives an empty result; further columns are ignored.  Components may be of any finite size; a
    score beyond double precision is infinite.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    v = keep(v.filter(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    asked = v.filter(F.col("vec_id") % every == 0).count()
    blocks = max(1, -(-asked // QUERY_BLOCK))
    # Equal vectors: the least ids that one result can hold; Spark trims each group before it is shuffled.
    least = v.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    nodes = least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))
    # Shards of a band of norms, as many as its vectors take; a shard is (width, band, number in the band).
    nodes = nodes.select("embedding", "vec_ids", F.size("embedding").alias("width"), band(F.col("embedding")).alias("band"))
    sizes = nodes.groupBy("width", "band").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    shard = (F.col("band").cast("long") + (1 << 20)) * (1 << 40) + F.pmod(F.xxhash64("embedding"), F.col("shards"))
    dealt = nodes.join(sizes, ["width", "band"]).withColumn("shard", shard)
    index = keep(dealt.groupBy("width", "shard").applyInArrow(_index, "width int, shard long, entry int, vectors binary, graph binary, vec_ids array<array<long>>"))
    queries = v.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("width", F.size("embedding"))
    # Every shard meets every block of queries of its width, each pair as one group.
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    named = index.select(F.col("width").alias("w"), F.col("shard").alias("s"))
    right = queries.join(named, F.col("width") == F.col("w")).select("width", F.col("s").alias("shard"), "block", "vec_id", "embedding")
    by = ["width", "shard", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: _search(a, b, k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLE: dict[str, str] = {}

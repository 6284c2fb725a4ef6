"""Itemsets, similarity, recommendation, graphs, sketches and clusters on hand-checked fixtures."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from granary.operators import cluster, graph, itemsets, recommend, similarity, sketch, twins
from granary.streaming import replay


def test_small_apriori(spark):
    baskets = [set("abc"), set("ab"), set("ac"), set("bc"), set("abc")]
    df = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "k int, v string")
    long = itemsets.baskets(df, "k", "v")
    got = {tuple(r["items"]): r["n"] for r in itemsets.frequent_itemsets(long, 3).collect()}
    assert got == {("a",): 4, ("b",): 4, ("c",): 4, ("a", "b"): 3, ("a", "c"): 3, ("b", "c"): 3}
    lines = {r["size"]: r["line"] for r in itemsets.report(itemsets.frequent_itemsets(long, 3)).collect()}
    assert lines == {1: "('a'),('b'),('c')", 2: "('a', 'b'),('a', 'c'),('b', 'c')"}


def test_basket_threshold_is_strict(spark):
    df = spark.createDataFrame([(n, i) for n in (1, 2, 3) for i in range(n)] + [(2, 0)], "k int, v int")
    assert {r["basket"] for r in itemsets.baskets(df, "k", "v", 2).collect()} == {3}


def test_apriori_equals_fpgrowth_and_son(spark):
    from pyspark.ml.fpm import FPGrowth

    rng = random.Random(2)
    rows = [(b, f"i{x}") for b in range(120) for x in {int(rng.random() ** 2 * 12) for _ in range(6)}]
    long = itemsets.baskets(spark.createDataFrame(rows, "k int, v string"), "k", "v")
    mine = {(tuple(r["items"]), r["n"]) for r in itemsets.frequent_itemsets(long, 20).collect()}
    arrays = long.groupBy("basket").agg(F.collect_list("item").alias("items"))
    theirs = {(tuple(sorted(r["items"])), r["freq"]) for r in FPGrowth(minSupport=19.5 / 120).fit(arrays).freqItemsets.collect()}
    assert mine == theirs and len(mine) > 12
    candidates, frequent = itemsets.son(long, 20, 3, F.col("basket") % 3)
    assert {(tuple(r["items"]), r["n"]) for r in frequent.collect()} == mine
    assert {i for i, _ in mine} <= {tuple(r["items"]) for r in candidates.collect()}


def test_jaccard_and_lsh(spark):
    sets = {"a": {1, 2, 3}, "b": {2, 3, 4}, "c": {9}}
    df = spark.createDataFrame([(k, m) for k, v in sets.items() for m in v], "item string, member long")
    assert [tuple(r) for r in similarity.jaccard_pairs(df, 0.5).collect()] == [("a", "b", 0.5)]
    rng = random.Random(4)
    base = [{rng.randrange(300) for _ in range(30)} for _ in range(15)]
    many = {f"s{i}": b for i, b in enumerate(base)} | {f"t{i}": set(list(b)[:27]) for i, b in enumerate(base)}
    df = spark.createDataFrame([(k, m) for k, v in many.items() for m in v], "item string, member long")
    exact = {tuple(r)[:2] for r in similarity.jaccard_pairs(df, 0.5).collect()}
    found = {tuple(r)[:2] for r in similarity.lsh_pairs(df, 0.5).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 10


def test_ratio_ladder(spark):
    ratios = [0.9, 1.1, 0.8, 1.2, 0.7, 1.3, 0.6, 1.4, 0.59, 1.41]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ratios)], "i int, r double")
    assert [r[0] for r in df.orderBy("i").select(recommend.ladder(F.col("r"))).collect()] == [0.9, 0.9, 0.7, 0.7, 0.5, 0.5, 0.3, 0.3, 0.1, 0.1]


RATINGS = [("u", "a", 4.0), ("u", "b", 2.0), ("v", "a", 5.0), ("v", "b", 1.0), ("v", "c", 3.0), ("w", "a", 2.0), ("w", "c", 4.0)]


def test_cold_starts(spark):
    ratings = spark.createDataFrame(RATINGS, "user string, item string, rating double")
    asked = spark.createDataFrame([("x", "a"), ("u", "z"), ("x", "z"), ("u", "c"), ("u", "c")], "user string, item string")
    got = {(r["user"], r["item"]): r["prediction"] for r in recommend.item_cf(ratings, asked).collect()}
    assert got["x", "a"] == pytest.approx(11 / 3) and got["u", "z"] == 3.0 and got["x", "z"] == pytest.approx(3.0)
    assert 1 <= got["u", "c"] <= 5 and len(got) == 4


def test_pearson_of_one_rater_is_undefined(spark):
    dev = spark.createDataFrame([("u", "a", 1.0), ("u", "b", -1.0), ("v", "a", 2.0), ("v", "c", 1.0), ("w", "a", 1.0), ("w", "c", 0.5)], "user string, item string, deviation double")
    got = {(r["a"], r["b"]): r["similarity"] for r in recommend.pearson(dev).collect()}
    assert got["a", "b"] is None and got["a", "c"] == pytest.approx(1.0)


def test_features_of_unknown_users_and_items(spark):
    pairs = spark.createDataFrame([("u", "i"), ("x", "i"), ("u", "y"), ("x", "y")], "user string, item string")
    users = spark.createDataFrame([("u", 4.0, None, "2020-01-01")], "user string, user_average double, user_count long, since string")
    items = spark.createDataFrame([("i", 2.0, 7)], "item string, item_average double, item_count long")
    got = {(r["user"], r["item"]): tuple(r)[2:] for r in recommend.features(pairs, users, items, "2020-01-31").collect()}
    assert got == {("u", "i"): (4.0, 0, 2.0, 7, 30), ("x", "i"): (3.0, None, 2.0, 7, None), ("u", "y"): (4.0, 0, 3.0, None, 30), ("x", "y"): (None,) * 5}


def test_hybrid_falls_back(spark):
    asked = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("d", "1")], "user string, item string")
    first = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 2.0)], "user string, item string, prediction double")
    second = spark.createDataFrame([("a", "1", 3.0), ("c", "1", 4.0)], "user string, item string, prediction double")
    got = sorted((r["user"], round(r["prediction"], 6)) for r in recommend.hybrid(asked, first, second, 3.3).collect())
    assert got == [("a", 2.88), ("b", 2.0), ("c", 4.0), ("d", 3.3), ("d", 3.3)]


def test_trees_learn_a_step(spark):
    rng = random.Random(3)
    rows = [(str(i), "x", 5.0 if a > 0.5 else 1.0, a, 1, 2.0, None if i % 7 == 0 else 3, 10) for i in range(200) for a in [rng.random()]]
    df = spark.createDataFrame(rows, "user string, item string, rating double, user_average double, user_count long, item_average double, item_count long, days int")
    got = {r["user"]: r["prediction"] for r in recommend.boosted_trees(df, df, rounds=5, share="all").collect()}
    assert sum(abs(got[r[0]] - r[2]) for r in rows) / len(rows) < 0.3
    best = recommend.tuned_trees(df, {"maxDepth": [1, 2], "maxIter": [2]}, folds=2)
    assert len(best.avgMetrics) == 2


def edges_of(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")


def test_path_betweenness(spark):
    got = {(r["src"], r["dst"]): r["betweenness"] for r in graph.edge_betweenness(edges_of(spark, [(1, 2), (2, 3), (3, 4)])).collect()}
    assert got == {(1, 2): 3.0, (2, 3): 4.0, (3, 4): 3.0}


def test_betweenness_sums_to_distances(spark):
    rng = random.Random(8)
    edges = edges_of(spark, {tuple(sorted(rng.sample(range(12), 2))) for _ in range(18)})
    total = sum(r["betweenness"] for r in graph.edge_betweenness(edges).collect())
    assert total == pytest.approx(sum(r["d"] for r in graph.shortest_paths(edges).filter("s < v").collect()))


def some_graphs():
    rng = random.Random(3)
    yield [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (6, 7)]
    for n, p in ((9, 0.3), (14, 0.2), (20, 0.15)):
        yield [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def all_shortest(edges, s):
    """Every shortest path from s, as lists of nodes."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    paths, front = {s: [[s]]}, [s]
    while front:
        new = {}
        for u in front:
            for v in near[u]:
                if v not in paths:
                    new.setdefault(v, []).extend([*p, v] for p in paths[u])
        paths |= new
        front = list(new)
    return paths


def test_betweenness_by_all_paths(spark):
    for edges in some_graphs():
        want = dict.fromkeys(edges, 0.0)
        for s in {x for e in edges for x in e}:
            for t, paths in all_shortest(edges, s).items():
                for p in paths:
                    for a, b in zip(p, p[1:]):
                        want[min(a, b), max(a, b)] += 0.5 / len(paths)
        for found in (graph.edge_betweenness(edges_of(spark, edges)), graph.joined_betweenness(edges_of(spark, edges))):
            assert {(r["src"], r["dst"]): r["betweenness"] for r in found.collect()} == pytest.approx(want)


def test_betweenness_in_tasks(spark, monkeypatch):
    edges = edges_of(spark, list(some_graphs())[2])
    want = sorted(graph.edge_betweenness(edges).collect())
    monkeypatch.setattr(graph, "_LITTLE", 0)
    got = sorted(graph.edge_betweenness(edges).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    every = graph.nodes(edges)
    assert sorted(graph.edge_betweenness(edges, every).collect())[0][2] == pytest.approx(want[0][2])


def test_girvan_newman_to_the_end(spark, monkeypatch):
    """In arrays and by joins: the same rounds, down to no edge."""
    edges = edges_of(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)])
    for mode in ("textbook", "reference"):
        best, history = graph.girvan_newman(edges, mode)
        monkeypatch.setattr(graph, "HELD_EDGES", -1)
        joined, again = graph.girvan_newman(edges, mode)
        monkeypatch.undo()
        assert sorted(best.collect()) == sorted(joined.collect())
        assert [(h["round"], h["edges"], h["communities"], round(h["modularity"], 9)) for h in history] == [(h["round"], h["edges"], h["communities"], round(h["modularity"], 9)) for h in again]
    best, history = graph.girvan_newman(edges)
    assert history[-1]["edges"] == 0
    assert sorted(tuple(r) for r in best.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]


def sharing(seed=3):
    """(node, group) with copies of some sets, nulls, and groups of all sizes."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        own = {rng.randrange(12) for _ in range(rng.randint(1, 9))}
        rows += [(i + 100 * j, f"g{x}") for j in range(rng.choice((1, 1, 3))) for x in own]
    return rows


def shared_by_pairs(rows, threshold):
    sets = {}
    for node, group in rows:
        sets.setdefault(node, set()).add(group)
    return {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold}


def test_cooccurrence_by_classes_and_blocks(spark, monkeypatch):
    """As by all pairs, in one block and in many, by matrices and pair by pair; links are between classes only."""
    rows = sharing()
    df = spark.createDataFrame([*rows, (None, "g1"), (5000, None), rows[0]], "node long, group string")
    for threshold, nodes, dense in ((1, 4096, 0.01), (3, 7, 0.01), (3, 7, 2), (5, 4096, 2)):
        monkeypatch.setattr(twins, "BLOCK_NODES", nodes)
        monkeypatch.setattr(twins, "_DENSE", dense)
        links, members = twins.merged(df, threshold)
        want = shared_by_pairs(rows, threshold)
        assert {(r["src"], r["dst"]): r["weight"] for r in twins.expanded(links, members).collect()} == want and want
        assert links.count() < len(want) and {r["node"] for r in members.collect()} == {x for e in want for x in e}


def test_near_sets(spark):
    """Against all pairs, with equal sets, a word that all share and sets of one word."""
    rng = random.Random(5)
    sets = {}
    for i in range(60):
        base = {f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 25))} | ({"all"} if i % 2 else set())
        for j in range(rng.randint(1, 3)):
            sets[10 * i + j] = frozenset(base - {min(base)} if j == 2 and len(base) > 1 else base)
    long = spark.createDataFrame([(i, w) for i, s in sets.items() for w in s], "item long, member string")
    for threshold in (0.5, 0.8):
        pairs, classes = similarity.near_sets(long, threshold)
        heads = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
        assert {r["item"]: r["head"] for r in classes.collect()} == {i: heads[s] for i, s in sets.items()}
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in heads.values() for b in heads.values() if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        assert {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()} == pytest.approx(want) and want


def test_son_report(spark):
    found = spark.createDataFrame([(["b"], 3), (["a"], 3), (["a", "b"], 3)], "items array<string>, n long")
    assert itemsets.son_report(found, found.filter("size(items) = 1")).first()["document"] == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')\n\n"


def test_stretches_of_batches():
    for n in range(40):
        spans = replay._spans(n)
        assert [x for a, b in spans for x in range(a, b)] == list(range(n)) and len(spans) == n.bit_count()


def test_girvan_newman_modes(spark):
    one = edges_of(spark, [(1, 2)])
    best, history = graph.girvan_newman(one)
    assert {r["component"] for r in best.collect()} == {1} and history[0]["modularity"] == 0
    assert graph.girvan_newman(one, "reference")[0].count() == 0
    two = edges_of(spark, [*combinations((1, 2, 3), 2), *combinations((4, 5, 6), 2), (3, 4)])
    best, history = graph.girvan_newman(two, rounds=1)
    assert {r["node"]: r["component"] for r in best.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert history[1]["communities"] == 2 and history[1]["modularity"] == pytest.approx(6 / 7 - 0.5)


def test_labels_and_components(spark):
    two = edges_of(spark, [*combinations(range(1, 5), 2), *combinations(range(11, 15), 2)])
    assert {r["label"] for r in graph.label_propagation(two).collect()} == {1, 11}
    path = edges_of(spark, [(i, i + 1) for i in range(40)] + [(100, 101)])
    assert {r["component"] for r in graph.components(path).collect()} == {0, 100}
    lines = [r["line"] for r in graph.community_report(graph.components(edges_of(spark, [(1, 2), (3, 4), (4, 5)]))).collect()]
    assert lines == ["'1', '2'", "'3', '4', '5'"]


def stream_of(spark, ids, size=50):
    return spark.createDataFrame([(i + 1, i // size, x) for i, x in enumerate(ids)], "seq long, batch long, id string")


def loop_bloom(ids, bits, family, size=50):
    set_, seen, out = set(), set(), {}
    for i, x in enumerate(ids):
        v = int.from_bytes(x.encode(), "big") % sketch.FIELD
        own = {(a * v + b) % p % bits for a, b, p in family}
        n = out.setdefault(i // size, [0, 0])
        if own <= set_:
            n[0] += x not in seen
        else:
            n[1] += 1
        set_ |= own
        seen.add(x)
    return {b: tuple(v) for b, v in out.items()}


def test_bloom_equals_a_loop_and_the_stream(spark):
    rng = random.Random(1)
    ids, family = [f"u{rng.randrange(150)}" for _ in range(300)], sketch.bloom_family(101, 2)
    rows = stream_of(spark, ids)
    got = {r["batch"]: (r["fp"], r["tn"]) for r in sketch.false_positive_rate(rows, 101, family).collect()}
    assert got == loop_bloom(ids, 101, family) and any(fp for fp, _ in got.values())
    streamed = {r["batch"]: (r["fp"], r["tn"]) for r in replay.bloom(replay.source(rows, "batch"), 101, family).collect()}
    assert streamed == got
    again = sketch.false_positive_rate(stream_of(spark, ["x", "x"])).collect()
    assert [(r["fp"], r["tn"], r["fpr"]) for r in again] == [(0, 1, 0.0)]


def test_reservoir(spark):
    short = stream_of(spark, [f"u{i}" for i in range(50)])
    assert sketch.reservoir(short).count() == 50
    assert [r["slot_60"] for r in sketch.reservoir_report(short).collect()] == [None]
    long = stream_of(spark, [f"u{i}" for i in range(700)], 100)
    assert sketch.reservoir(long).count() == 100
    report = sorted(map(tuple, sketch.reservoir_report(long).collect()))
    assert sorted(tuple(r) for r in replay.reservoir(replay.source(long, "batch")).select("batch", "seqnum", *[f"slot_{s}" for s in (0, 20, 40, 60, 80)]).collect()) == report


def test_distinct_estimates(spark):
    rows = stream_of(spark, [f"k{i % 200}" for i in range(1000)], 500)
    got = sketch.distinct_estimate(rows).collect()
    assert all(r["n_rows"] == 500 and r["n_distinct"] == 200 and 40 <= r["estimate"] <= 800 for r in got)
    assert sorted(map(tuple, replay.per_batch(replay.source(rows, "batch"), sketch.distinct_estimate).collect())) == sorted(map(tuple, got))


def loop_estimates(rows, family, limit, group):
    out = {}
    for b, x in rows:
        n, ids = out.setdefault(b, [0, set()])
        out[b] = [n + 1, ids | ({x} - {None})]
    for b, (n, ids) in out.items():
        hashes = [[(int.from_bytes(x.encode(), "big") % sketch.FIELD * a + c) % p % limit for x in ids] for a, c, p in family]
        most = [max((1 if h == 0 else (h & -h).bit_length() - 1 for h in own), default=None) for own in hashes]
        powers = sorted(2.0 ** (sum(most[g : g + group]) / group) for g in range(0, len(most), group)) if ids else []
        out[b] = (n, len(ids), int(powers[len(powers) // 2]) if ids else None)
    return out


@pytest.mark.parametrize(("limit", "hashes", "group"), [(1000, 100, 10), (7, 21, 7), (2, 70, 1), (1 << 20, 9, 3)])
def test_estimates_equal_a_loop(spark, limit, hashes, group):
    """Repeats, null and empty ids, a batch of nulls alone, and hashes that are zero; no row is made for an id and a hash."""
    rng = random.Random(limit)
    family = sketch.fm_family(hashes, limit)
    rows = [(f"b{rng.randrange(6)}", rng.choice([None, "", "\u00e9", *(f"id{i}" for i in range(40))])) for _ in range(200)] + [("none", None), ("none", None), ("one", "x")]
    stream = spark.createDataFrame([*rows, (None, "y")], "batch string, id string")
    found = sketch.distinct_estimate(stream, group, limit, family)
    assert {r["batch"]: (r["n_rows"], r["n_distinct"], r["estimate"]) for r in found.collect()} == loop_estimates(rows, family, limit, group)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_that_would_overflow(spark):
    with pytest.raises(ValueError, match="63 bits"):
        sketch.distinct_estimate(stream_of(spark, ["x"]), 1, 1000, [(1 << 40, 1, 10_007)])


def steps_of(monkeypatch):
    """The numbers of the micro-batches that ran."""
    ran, run = [], replay._run
    monkeypatch.setattr(replay, "_run", lambda stream, step: run(stream, lambda df, n: (ran.append(n), step(df, n))[1]))
    return ran


def test_reservoir_of_few_micro_batches(spark, monkeypatch):
    """Sixty batches, of unlike sizes and with a gap, come in a few micro-batches; slots are held from one to the next."""
    ran = steps_of(monkeypatch)
    rows = [(i + 1, b + 5 * (b > 30), f"u{i}") for i, b in enumerate(sorted(int(60 * (i / 900) ** 2) for i in range(900)))]
    stream = spark.createDataFrame(rows, "seq long, batch long, id string")
    want = sorted(map(tuple, sketch.reservoir_report(stream).collect()))
    got = replay.reservoir(replay.source(stream, "batch")).select("batch", "seqnum", *[f"slot_{s}" for s in (0, 20, 40, 60, 80)])
    assert sorted(map(tuple, got.collect())) == want and len(want) == 60
    assert 10 < len(ran) <= 30


def test_estimates_of_few_micro_batches(spark, monkeypatch):
    ran = steps_of(monkeypatch)
    monkeypatch.setattr(replay, "MICRO_BATCHES", 4)
    rows = stream_of(spark, [f"k{i * i % 70}" for i in range(900)], 15)
    got = replay.per_batch(replay.source(rows, "batch"), sketch.distinct_estimate).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, sketch.distinct_estimate(rows).collect())) and len(got) == 60
    assert ran == [0, 1, 2, 3]
    ids, family = [f"u{i * 7919 % 151}" for i in range(300)], sketch.bloom_family(101, 2)
    streamed = replay.bloom(replay.source(stream_of(spark, ids, 15), "batch"), 101, family).collect()
    assert {r["batch"]: (r["fp"], r["tn"]) for r in streamed} == loop_bloom(ids, 101, family, 15)


def test_black_box_draws_with_replacement(spark):
    got = replay.ask(spark.createDataFrame([("a",), ("b",)], "value string"), 10, 3)
    assert got.count() == 30 and {r["id"] for r in got.collect()} == {"a", "b"}


def test_mahalanobis(spark):
    found = {"c": (2, [2.0, 2.0], [4.0, 4.0])}
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 1.0])], "id int, features array<double>")
    from granary.functions.columns import mahalanobis

    n, t, q = found["c"]
    assert [r[0] for r in df.orderBy("id").select(mahalanobis(F.col("features"), F.lit(float(n)), F.lit(t), F.lit(q))).collect()] == [0.0, 2.0]
    assert [r["k"] for r in cluster.nearest(df, found, 2.0, "k").orderBy("id").collect()] == ["c", None]  # strict


def test_close_summaries_merge():
    a, b, c = (2, [0.0], [2.0]), (2, [2.0], [4.0]), (2, [200.0], [20002.0])
    found, became = cluster.merge_close({"a": a, "b": b, "c": c}, 2.0)
    assert set(found) == {"a", "c"} and became == {"b": "a"} and found["a"] == (4, [2.0], [6.0])


def test_clusters_by_chunks(spark):
    rng = random.Random(6)
    centers = [(0, 0), (30, 0), (0, 30)]
    rows = [(i, [rng.gauss(c, 1) for c in centers[i % 3]]) for i in range(300)] + [(1000, [500.0, 500.0])]
    found, history = cluster.by_chunks(spark.createDataFrame(rows, "id long, features array<double>"), 3)
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert len(got) == len(rows) == found.count()
    assert history[-1]["main_points"] + history[-1]["small_points"] + history[-1]["kept_points"] == len(rows)
    assert got[1000] == -1
    for k in range(3):
        own = [got[i] for i in range(300) if i % 3 == k and got[i] >= 0]
        assert len(own) > 60 and len(set(own)) == 1

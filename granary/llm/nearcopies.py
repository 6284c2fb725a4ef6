"""Near copies: SimHash links first, then banded MinHash for the rest, every link checked on the shingle sets.

Texts with equal sets of word shingles are one class.  Fingerprints of classes that the
popcount grid finds within a few bits are proposed first, and those whose Jaccard similarity
suffices connect most of what is dense.  A 64-bit fingerprint can't hold all pairs of a
similarity of 0.8 together (they differ in ten bits on average), so classes that agree in all
rows of some MinHash band meet in a cell as well.  Cells whose members are connected already
are closed; in all others every pair of unconnected members is compared on its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import simhash
from granary.llm.common import keep, partitions, pieces, release
from granary.operators.components import connected_components

SEED = 42
#: A pair of similarity s shares a cell with probability 1 - (1 - s**ROWS)**BANDS: all but 5 in a million at 0.8.
BANDS, ROWS = 40, 6
#: Shingles of a block of a crowded cell; two blocks are compared at a time, so memory is bounded.
BLOCK = 1 << 20


def shingles(text: bytes | None, n: int) -> list[int]:
    """Hashes of a text's n-word shingles, as often as they come; of fewer words, all are one shingle."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return []
    joined, k = b" ".join(w), min(n, len(w))
    ends = list(accumulate(len(x) + 1 for x in w))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :])]


def _class(members) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(members.tobytes(), SEED)


def _sketches(batches: Iterator, n: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        for part in pieces(batch, "text", 2 << 20):
            cls, size, fps, bands = [], [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                h = np.array(shingles(text, n), dtype=np.uint64)
                fps.append(simhash.fingerprint(h))
                h = np.unique(h)
                cls.append(_class(h))
                size.append(len(h))
                if not len(h):
                    bands.append([])
                    continue
                least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(h), 1024):
                    least = np.minimum(least, np.multiply.outer(factors, h[at : at + 1024]).min(axis=1))
                raw = least.tobytes()
                bands.append(np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)], dtype=np.uint64).view(np.int64))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (cls, fps)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("none", "id", "th")] + [longs[0], pa.array(size, pa.int64()), longs[1], pa.array(bands, pa.list_(pa.int64()))], ["none", "id", "th", "cls", "size", "fp", "bands"])


def _sets(batches: Iterator, n: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            sets = [np.unique(np.array(shingles(text, n), dtype=np.uint64)) for text in part.column("text").cast(pa.binary()).to_pylist()]
            cls = np.array([_class(h) for h in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["cls", "members"])


def _similar(common, m, n, least: tuple[int, int]):
    """Whether common / (m + n - common) is at least the fraction, in whole numbers."""
    return common * (least[0] + least[1]) >= (m + n) * least[0]


def cell_links(cls, root, sets: list, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between members of a cell with different roots, enough to connect all that such links connect.

    All pairs but those within the largest root's members are compared, a member with all others
    at a time; those that a link has connected meanwhile are left out.
    """
    import numpy as np

    _, own, count = np.unique(root, return_inverse=True, return_counts=True)
    if len(count) < 2:
        return []
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    mark = np.zeros(len(values), dtype=np.int64)
    out = []
    for i in np.flatnonzero(own != count.argmax()):
        mine = flat[starts[i] : starts[i] + size[i]]
        mark[mine] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[mine] = 0
        for j in np.flatnonzero(_similar(common, size[i], size, least) & (own != own[i])):
            if own[j] != own[i]:
                out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
                own[own == own[j]] = own[i]
        if (own == own[i]).all():
            break
    return out


def _links(batches: Iterator, least: tuple[int, int]) -> Iterator:
    """Rows sorted by cell -> links; a cell may span batches."""
    import numpy as np
    import pyarrow as pa

    held, at = ([], [], []), None

    def links():
        found = cell_links(np.array(held[0]), np.array(held[1]), held[2], least)
        return pa.RecordBatch.from_arrays([pa.array([int(e[k]) for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        members = batch.column("members")
        values, offsets = members.values.to_numpy(), members.offsets.to_numpy()
        for k, (cell, cls, root) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("cls").to_pylist(), batch.column("root").to_pylist())):
            if cell != at:
                if len(held[0]) > 1:
                    yield links()
                held, at = ([], [], []), cell
            held[0].append(cls)
            held[1].append(root)
            held[2].append(np.array(values[offsets[k] : offsets[k + 1]]))
    if len(held[0]) > 1:
        yield links()


def _components(texts: DataFrame, classes: DataFrame, n: int, least: tuple[int, int]) -> DataFrame | None:
    """(node, component) of classes that links of at least the similarity connect; None without a link."""
    # What the fingerprints propose: classes of one fingerprint, and those whose fingerprints link.
    heads = classes.filter("size > 0").groupBy("fp").agg(F.min("cls").alias("head"))
    close = simhash.links(heads.select("fp"))
    close = close.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    same = classes.filter("size > 0").join(heads, "fp").filter("cls <> head").select(F.col("head").alias("x"), F.col("cls").alias("y"))
    pairs = keep(close.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    # What bands propose: cells of more than one class.
    grid = classes.select(F.explode("bands").alias("cell"), "cls", "size")
    crowds = grid.groupBy("cell").agg(F.count("*").alias("crowd"), F.sum("size").alias("total")).filter("crowd > 1")
    members = keep(grid.drop("size").join(crowds, "cell"))
    wanted = members.select("cls").unionByName(pairs.select(F.col("a").alias("cls"))).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = wanted.join(classes.select("cls", "rep"), "cls").select("rep.*")
    sets = keep(texts.join(wanted, ["none", "id", "th"], "left_semi").select("text").mapInArrow(lambda b: _sets(b, n), "cls long, members array<long>").dropDuplicates(["cls"]))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b")
    edges = keep(both.filter(_similar(F.size(F.array_intersect("ma", "mb")), F.size("ma"), F.size("mb"), least)).select("a", "b"))
    found = None if edges.isEmpty() else keep(connected_components(edges))
    # Cells that hold unconnected classes; a large one in blocks, each pair of blocks by itself.
    rooted = members.withColumn("root", F.col("cls")) if found is None else members.join(found, members.cls == found.node, "left").select("cell", "cls", "total", F.coalesce("component", "cls").alias("root"))
    open_ = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("cell")
    blocks = F.ceil(F.col("total") / BLOCK).cast("long")
    parts = rooted.join(open_, "cell", "left_semi").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    others = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("own"))))
    met = parts.withColumn("other", others).select(F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"), "cls", "root")
    dealt = met.join(sets, "cls").repartition(partitions(texts.sparkSession), "cell").sortWithinPartitions("cell")
    more = keep(dealt.select("cell", "cls", "root", "members").mapInArrow(lambda b: _links(b, least), "a long, b long").distinct())
    release(members, pairs, sets)
    if more.isEmpty():
        return found
    # What was connected, as links to its component, and the new links.
    all_ = more if found is None else found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    return keep(connected_components(all_))


def without_near_copies(docs: DataFrame, n: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of near copies: one of each.

    Rows link if the Jaccard similarity of their n-word shingle sets is at least the fraction;
    rows without words (null, empty or blank texts) are copies of each other.  The row with the
    least doc_id stands, of rows of the group with one id the first by text, of equal ones any;
    a row that shares an id with another but not its group stands for its own.  Rows without an
    id stand for a group only if none in it has one.  An empty table gives an empty result; any
    further columns are kept, whatever their names.
    """
    rest = F.xxhash64(*[F.col(c).cast("string") for c in ("text", "lang", "source") if c in docs.columns])
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.col("doc_id").cast("long"), rest).alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"),
    )
    texts = keyed.drop("row")
    rows = keep(texts.mapInArrow(lambda b: _sketches(b, n), "none int, id long, th long, cls long, size long, fp long, bands array<long>"))
    classes = keep(rows.groupBy("cls").agg(F.min(F.struct("none", "id", "th")).alias("rep"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    found = _components(texts, classes, n, least)
    named = classes.select("cls", F.struct("rep.none", "rep.id").alias("key"), F.col("cls").alias("root"))
    if found is not None:
        named = classes.join(found, classes.cls == found.node, "left").select("cls", F.struct("rep.none", "rep.id").alias("key"), F.coalesce("component", "cls").alias("root"))
    firsts = named.join(named.groupBy("root").agg(F.min("key").alias("key")), ["root", "key"]).select("cls", "key.none", "key.id", "root")
    stay = rows.join(firsts, ["cls", "none", "id"]).select("none", "id", F.col("th").alias("same"), "root").distinct()
    # Texts are dealt by id alone, so that the join and the window share one exchange of them.
    held = keyed.join(stay, ["none", "id"]).filter(F.col("th").bitwiseXOR(F.col("same")) == 0)
    first = Window.partitionBy("none", "id", "root").orderBy("text")
    return held.withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")

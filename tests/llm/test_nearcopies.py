"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest

from granary.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string"


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def survivors(rows):
    """(doc_id, text) of the first row of each group, rows with an id."""
    rows = sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1]))
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if root[i] != root[j] and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return [r for i, r in enumerate(rows) if root[i] == i]


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).repartition(3)
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.dedup(spark, docs, "").collect()), key=str)


def test_edited_copies(spark):
    """Copies with edited words at similarities on both sides of 0.8, and a group whose cells are crowded."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(5000)}"
    rows, at = [], 0
    for edits in [0, 1, 2, 3, 4, 5] * 6:
        base = [word() for _ in range(150)]
        other = list(base)
        for p in range(edits):
            other[10 + 25 * p] = word() + "x"
        rows += [(at, " ".join(base)), (at + 1, " ".join(other))]
        at += 2
    base = [word() for _ in range(60)]
    rows += [(at + i, " ".join([*base[:-1], f"end{i}"])) for i in range(60)]
    rows += [(at + 100 + i, " ".join([*base, *[word() for _ in range(12 + i % 8)]])) for i in range(40)]
    rows += [(900, ""), (901, None), (902, " \n"), (903, "two words"), (904, "Two  words"), (905, "two")]
    want = sorted(survivors(rows), key=str)
    assert left(spark, rows) == want and len(want) < len(rows) - 70
    assert left(spark, []) == []


def test_rows_keep_their_identity(spark):
    """Rows that share an id but not a text, null ids, repeated rows, columns with names that the stage uses inside."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, b), (7, b), (7, c), (9, a), (9, a), (None, a), (None, c + " more"), (None, a.upper()), (2**62 + 5, "x y"), (None, "x  Y"), (None, "only here"), (None, "only here")]
    schema = "doc_id long, text string, row string, id int, none string, place int, root string, th string, `a.b` int"
    docs = spark.createDataFrame([(i, t, "r", 1, "n", 2, "q", "h", 4) for i, t in rows], schema).repartition(3)
    out = corpus_pipeline.dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(3, b), (7, c), (9, a), (2**62 + 5, "x y"), (None, "only here")])


def test_crowded_cells_in_blocks(spark, monkeypatch):
    """Cells that are cut into many blocks give the same groups."""
    rng = random.Random(6)
    base = [f"v{rng.randrange(900)}" for _ in range(60)]
    rows = [(i, " ".join([*base[: 60 - i % 9], *[f"v{rng.randrange(900)}" for _ in range(i % 11)]])) for i in range(60)]
    monkeypatch.setattr(nearcopies, "BLOCK", 300)
    assert left(spark, rows) == sorted(survivors(rows), key=str)


@pytest.mark.parametrize("size", ["sf0.01"])
def test_given_documents(spark, size):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()]
    got = left(spark, rows)
    assert got == sorted(survivors(rows), key=str)
    assert not {255, 770, 944} & {i for i, _ in got}  # copies of 1, 643 and 709 with edited words

"""The pipeline's stages against what brute force keeps, on a small table."""

import corpus_pipeline
import pytest

from granary.llm import decontaminate, quality, secrets
from granary.llm.common import keep


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.unionByName(docs.filter("doc_id % 100 = 3")).write.parquet(f"{path}/documents.parquet")  # some rows twice
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rows = {n: None for n in names}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        at.write.parquet(f"{folder}/{name}.parquet")
        at = spark.read.parquet(f"{folder}/{name}.parquet")
        rows[name] = at.collect()
        if name != names[-1]:
            assert at.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r["doc_id"] for r in docs.collect() if model.score([(r["text"] or "").encode()])[0] >= 0.7}
    assert {r["doc_id"] for r in rows["quality"]} == good and 0 < len(good) < 1000
    # One of each group that pairs of a similarity of 0.8 link.
    from tests.llm.test_nearcopies import survivors

    left = rows["near_dedup"]
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted(survivors([(r["doc_id"], r["text"]) for r in rows["quality"]]))
    seeds = decontaminate.Seeds([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in rows["decontamination"]} == {r["doc_id"] for r in left if not seeds.find([r["text"].encode()])}
    before = {r["doc_id"]: r["text"] for r in rows["decontamination"]}
    known = secrets.ranked_words(spark.read.parquet(f"{folder}/decontamination.parquet"))
    assert {r["doc_id"]: r["text"] for r in rows["secrets"]} == {d: secrets.redact(t, vocabulary=known) for d, t in before.items()}
    assert not any(secrets.scan(r["text"], vocabulary=known) for r in rows["secrets"])
    assert {r["doc_id"] for r in rows["packing"]} == set(before)
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows["packing"]))


def test_stages_on_odd_rows(spark, docs, none, folder):
    """Null ids and texts, repeated rows, long texts, further columns with clashing names; then no rows at all."""
    for at in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            before, at = at, keep(stage(spark, at, folder))
            if name == "packing":
                assert {r["doc_id"] for r in at.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
            else:
                assert at.columns == docs.columns and at.schema["text"].dataType == docs.schema["text"].dataType
                assert at.join(before, [before.doc_id.eqNullSafe(at.doc_id)], "left_anti").count() == 0
            if name in ("secrets", "packing"):
                assert (at.select("doc_id").distinct().count()) == before.select("doc_id").distinct().count()
        assert (at.count() > 0) == (before.count() > 0)

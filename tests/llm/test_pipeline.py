"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_llm import by_lines, check_packing
from test_near_copies import least_of

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as c
    from tendon.llm.common import saved
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "src1", None), (90002, "12 34", None, None, 5)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, f in c.STAGES:
        out.append(saved(f(spark, out[-1], ROOT), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_keeps_what_has_letters(stages):
    assert ids(stages[1]) == [i for i in ids(stages[0]) if i < 90000]


def test_lines(stages):
    assert texts(stages[2]) == by_lines(texts(stages[1]))


def test_language_without_labels_keeps_what_has_letters(spark, stages):
    import corpus_pipeline as c
    bare = stages[0].withColumn("lang", F.lit(None).cast("string"))
    assert ids(c.language(spark, bare, ROOT)) == [i for i in ids(stages[0]) if i < 90000]


def test_near_duplicates(stages):
    least, _ = least_of(texts(stages[2]))
    assert ids(stages[3]) == sorted(set(least.values()))


def test_stages_remove_the_scratch_of_those_before(spark, stages):
    import os

    import corpus_pipeline as c
    from tendon.llm import common
    c.language(spark, stages[0], ROOT)
    start = len(common._MADE)
    result = c.lines(spark, stages[1], ROOT)
    made = common._MADE[start:]
    lines = common.saved(result, "lines")
    assert made and all(os.path.exists(p) for p in made)
    c.near_duplicates(spark, lines, ROOT)
    assert not [p for p in made if os.path.exists(p)]
    assert lines.count() == stages[2].count() and stages[1].count() > 0


def test_mixture_takes_each_once_and_most(stages):
    before, after = ids(stages[3]), ids(stages[4])
    assert len(set(after)) == len(after) and set(after) < set(before)
    words = lambda df: sum(len(t.split()) for t in texts(df).values())
    assert 0.75 * words(stages[3]) < words(stages[4]) <= 0.9 * words(stages[3])


def test_packing(stages):
    check_packing(stages[5].collect(), texts(stages[4]))


def test_run_on_an_empty_table(spark, stages, tmp_path):
    import corpus_pipeline as c
    stages[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_stages_called_alone_read_small_batches(spark):
    """Stages may be called without `run`; whole texts come in batches bounded by rows and bytes in any case."""
    import pyarrow as pa
    from tendon.llm.common import BATCH, stage

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})

    @stage
    def told(spark, docs, sf_dir):
        return docs.mapInArrow(sizes, "n long, bytes long")

    rows, most = BATCH.values()
    for name in BATCH:
        spark.conf.unset(name)
    try:
        for n, length in ((3 * rows, 10), (200, most // 40)):
            got = told(spark, spark.range(0, n, 1, 1).select(F.expr(f"repeat('x', {length})").alias("text")), ROOT).collect()
            assert sum(r.n for r in got) == n
            assert max(r.n for r in got) <= rows and max(r.bytes for r in got) < 1.1 * most
    finally:
        for name in BATCH:
            spark.conf.unset(name)

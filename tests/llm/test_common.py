import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, simhash, toxicity
from millrace.llm.common import spread_join, staged, unstage
from millrace.llm.tokenizing import encoder, public_path


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_as_others_do(spark, how):
    rows = [(k, "ab"[k % 2], i) for i, k in enumerate([7] * 300 + [8] * 120 + list(range(20)))] + [(None, "a", -i) for i in range(200)] + [(7, "b", 5), (7, "b", 5)]
    left = staged(spark.createDataFrame(rows, "k int, s string, i int"), "rows")
    side = spark.createDataFrame([(k, "ab"[k % 2], f"v{k}") for k in range(5, 15)] + [(None, "a", "none")], "k int, s string, v string")
    want = sorted(map(tuple, left.join(side, ["k", "s"], how).collect()), key=str)
    counts = left.groupBy("k", "s").count()
    for options in ({}, {"least": 50}, {"least": 50, "counts": counts}):
        got = spread_join(left, side, ["k", "s"], how, **options)
        assert got.columns == ["k", "s", "i", "v"] and sorted(map(tuple, got.collect()), key=str) == want
    assert spread_join(left.limit(0), side, ["k", "s"], how).count() == 0


def test_staged_frames_are_deleted(spark):
    frame = staged(spark.range(5).select("id", F.lit("x").alias("t")), "five", "zstd")
    assert frame.count() == 5
    unstage(frame)
    with pytest.raises(Exception):
        spark.read.schema(frame.schema).parquet(frame.staged_path).count()


class Caught:
    """In place of a table: gives the function that its tasks would run."""

    def __init__(self, df):
        self.schema, self.sparkSession = df.schema, df.sparkSession

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def withColumnRenamed(self, old, new):
        return self


def test_tasks_of_the_pipeline_take_over_no_cache_of_others(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = {"net": toxicity.new_parameters(toxicity.Shape(), 1), "window": 16, "excess": toxicity.np.zeros((2, 1 << toxicity.COUNT_BITS), "f4")}
    near = simhash.fingerprints(Caught(docs), 5, 256, "doc_id", "text", sets=True).run
    scoring = toxicity.score_toxicity(Caught(docs), model).run
    packed = packing.cut_pieces(Caught(docs), public_path(), 2, 4096, "doc_id", "text").run
    for run, kept in ((near, 0), (scoring, 0), (packed, 1)):
        encoder(public_path())
        assert list(run(iter([]))) == []
        assert encoder.cache_info().currsize == kept

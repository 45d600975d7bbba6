from funcframe import operators as ops
from funcframe import streaming
from funcframe.model import parse


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    rows = [(1, i, float(v)) for i, v in enumerate([0, 0, 5, 1, 1, 9])]
    spark.createDataFrame(rows, "k int, x int, a double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k int, x int, a double").parquet(str(tmp_path / "in"))
    df, m = streaming.apply(stream().select("x", "a"), parse("x -> a: double"), [ops.Selection("a", ">", "1"), ops.Rename("a", "b")])
    assert str(m) == "x -> b" and sorted(run(spark, df, "plain")) == [(2, 5.0), (5, 9.0)]
    assert sorted(run(spark, streaming.max_delta(stream(), "k", "x", "a", 2), "delta")) == [(1, 0, 0.0), (1, 1, 0.0), (1, 3, 1.0), (1, 4, 1.0)]
    assert [r[1] for r in sorted(run(spark, streaming.on_change(stream(), "k", "x", "a"), "change"))] == [0, 2, 3, 5]


def test_binned_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "s int, v double").selectExpr("timestamp_seconds(s * 40) AS t", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(spark, streaming.binned(s, "t", "1 minute", "1 minute", "v"), "bins", "complete")
    assert sorted((r[1], r[4]) for r in got) == [(0.5, 2), (2.0, 1), (3.0, 1)]

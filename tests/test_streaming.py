from __future__ import annotations

from recitary.operators import sequence
from recitary.streaming import frames as S


def test_stream_equals_batch(spark, tmp_path):
    ids = [5, 5, 0, 5, 7, 7, 7, 0, 2, 0]
    rows = [("u", t, i) for t, i in enumerate(ids)] + [("v", t, i) for t, i in enumerate([1, 1, 3, 0])]
    df = spark.createDataFrame(rows, "utt string, t long, id int")
    for k, (a, b) in enumerate(((0, 3), (3, 6), (6, 10))):
        df.where(f"t >= {a} and t < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            S.stream_segments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("utt", "seg", "id", "frames", "start").collect()}
    assert got == {tuple(r) for r in sequence.run_segments(df).select("utt", "seg", "id", "frames", "start").collect()}


def test_windowed_rate(spark):
    df = spark.sql("SELECT 'u' AS utt, timestamp'2024-01-01 00:00:01' AS ts UNION ALL SELECT 'u', timestamp'2024-01-01 00:00:12'")
    assert [r.frames for r in S.windowed_rate(df, "ts").orderBy("start").collect()] == [1, 1]

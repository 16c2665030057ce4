"""Splits without leakage, chunks and label codes.

Order is by md5 of the key, so a split is the same on any engine and layout. Ranks run
over distinct keys only, never over rows, and by a two-level count that needs no single
partition: how many keys lie in smaller buckets of the hash, plus the rank in the own one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recitary.sources.scratch import written


def key_hash(*cols: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct keys with `rank` from 1 in hash order and `total`. The 4,096 bucket counts are
    a bounded table, so their running sum is the only single-partition step."""
    own = keys.select(*cols).distinct().withColumn("__h", key_hash(*cols)).withColumn("__b", F.substring("__h", 1, 3))
    counts = own.groupBy("__b").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__b")
    before = counts.select("__b", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *cols))
    return own.withColumn("__in", inner).join(F.broadcast(before), "__b").select(*cols, (F.col("__before") + F.col("__in")).cast("long").alias("rank"), "total")


def test_keys(keys: DataFrame, ratio: float, *cols: str) -> DataFrame:
    """The first ceil(ratio * n) keys in hash order."""
    return ranked(keys, *cols).where(F.col("rank") <= F.ceil(F.lit(ratio) * F.col("total"))).select(*cols)


def group_disjoint_split(df: DataFrame, speaker: str, verse: list[str], speaker_ratio: float = 0.25, verse_ratio: float = 0.2) -> DataFrame:
    """df with `part`: test if speaker and verse are both test keys, train if neither, else
    dropped. The key tables join left, which Spark broadcasts while they are small."""
    s = test_keys(df, speaker_ratio, speaker).withColumn("__s", F.lit(True))
    v = test_keys(df, verse_ratio, *verse).withColumn("__v", F.lit(True))
    out = df.join(s, speaker, "left").join(v, verse, "left")
    a, b = F.col("__s").isNotNull(), F.col("__v").isNotNull()
    return out.withColumn("part", F.when(a & b, "test").when(~a & ~b, "train").otherwise("dropped")).drop("__s", "__v")


def overlap(split: DataFrame, *cols: str) -> DataFrame:
    """Keys found in both train and test: none, for a sound split."""
    return split.where(F.col("part") == "train").select(*cols).intersect(split.where(F.col("part") == "test").select(*cols))


def verify(split: DataFrame, speaker: str, verse: list[str]) -> None:
    if not overlap(split, speaker).isEmpty() or not overlap(split, *verse).isEmpty():
        raise ValueError("train and test share speakers or verses")


def split_stats(split: DataFrame, speaker: str, verse: list[str]) -> DataFrame:
    """Rows, share, speakers and verses of each part."""
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return split.groupBy("part").agg(F.count("*").alias("rows"), (100 * F.count("*") / total).alias("percent"), F.count_distinct(speaker).alias("speakers"), F.count_distinct(*verse).alias("verses"))


def random_split(df: DataFrame, key: str, ratio: float = 0.2) -> DataFrame:
    """df with `part`: a seedless split by rank of the key's hash."""
    t = test_keys(df, ratio, key).withColumn("__t", F.lit(True))
    return df.join(t, key, "left").withColumn("part", F.when(F.col("__t"), "test").otherwise("train")).drop("__t")


def _ordered(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df with `rank` from 1 in the order of columns and `total`, without a single partition: Spark's range
    exchange sorts, ranges are counted, and the counts before a range are added. The counts are
    one row for each range. Ranges come from samples, so they are written before they are read twice."""
    own = df.repartitionByRange(parts, *order).withColumn("__b", F.spark_partition_id())
    own = written(own.withColumn("__in", F.row_number().over(Window.partitionBy("__b").orderBy(*order))), "ranked")
    counts = own.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    return own.join(F.broadcast(before), "__b").withColumn("rank", F.col("__before") + F.col("__in")).drop("__b", "__in", "__before")


def label_encode(df: DataFrame, col: str, out: str = "label", parts: int | None = None) -> DataFrame:
    """df with the 0-based place of the value among its sorted distinct values; null for null."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return df.join(_ordered(values, [col], parts).select(col, (F.col("rank") - 1).alias(out)), col, "left")


def ranked_by(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """df with `rank` from 1 in the order of a column and `total`. Rows that tie rank in the order
    of their other columns, so that the ranks are the same on every run; nulls come first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [c for c, kind in df.dtypes if c != order and not kind.startswith(("map", "variant"))]
    return _ordered(df, [order, *ties], parts)

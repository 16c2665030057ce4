"""The catalogue's queries by name, and the helpers they share."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recitary.operators import sequence

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Words and the tokens stated for them, in a file beside this one, on executors within the zip file.
GOLDEN = [
    (word, tokens)
    for word, _, tokens in (line.partition("\t") for line in (files("recitary.plans") / "golden_words.txt").read_text(encoding="utf-8").split("\n") if line and line[0] != "#")
]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("t"), "event_id", "event_type", "value")


def segments(spark, sf_dir) -> DataFrame:
    return sequence.run_segments(frames(spark, sf_dir), "user_id", "t", "event_type", "error")


def values(rows: list[tuple]) -> str:
    """Rows as the body of a SQL VALUES list."""
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def rows(spark, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


WORD = "[^\\x20\\x09-\\x0D]+"


def spoken(spark, sf_dir, words: list[str]) -> DataFrame:
    """The words of all documents, each standing for one of the given ones, by its md5: doc_id, pos, word."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(own_words()).alias("pos", "w"))
    return x.select("doc_id", "pos", stands_for(F.col("w"), words).alias("word"))


def own_words():
    return F.regexp_extract_all("text", F.lit(WORD), F.lit(0))


def stands_for(w, words: list[str]):
    place = F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % len(words)
    return F.get(F.array(*[F.lit(x) for x in words]), place.cast("int"))


def said(spark, sf_dir, words: list[str]) -> DataFrame:
    """Those of the given words that are spoken, how often and in how many documents: word, times, docs."""
    return spoken(spark, sf_dir, words).groupBy("word").agg(F.count("*").alias("times"), F.count_distinct("doc_id").alias("docs"))


def spoken_sql(words: list[str]) -> str:
    """CTEs of spoken() as `spoken` and of said() as `said`."""
    listed = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    return f"""own AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
spoken AS (SELECT doc_id, pos, {listed}[CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % {len(words)} + 1] AS word FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM own)),
said AS (SELECT word, count(*) AS times, count(DISTINCT doc_id) AS docs FROM spoken GROUP BY word)"""


SEGMENTS = """
WITH f AS (SELECT user_id, ts, event_id, event_type,
             CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
g AS (SELECT user_id, run, event_type, count(*) AS frames FROM r WHERE event_type <> 'error' GROUP BY ALL),
s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY run) - 1 AS INTEGER) AS seg, event_type, frames FROM g)
"""

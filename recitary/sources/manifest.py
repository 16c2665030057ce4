"""Manifests and text files: scans with explicit schemas, parsing, joins, sinks.

Files keep no order in Spark, so every line scan carries its own key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "surah int, ayah int, path_of_audio string, reciter_name string, ayah_text string"
PHONEME_MANIFEST = MANIFEST + ", phonemes string"
RECITERS = "idx int, name string, path string, label string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A header row, quoted fields over several lines, doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def parse_lines(lines: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """surah|ayah|text lines as columns. Blank lines, lines without three fields and empty texts
    go. The text keeps further bars; strict=True wants exactly three fields instead."""
    parts = F.split(F.trim(F.col(value)), r"\|", -1 if strict else 3)
    out = lines.withColumn("__p", parts).where(F.size("__p") == 3)
    out = out.withColumns({"surah": F.trim(F.get("__p", F.lit(0))), "ayah": F.trim(F.get("__p", F.lit(1))), "text": F.trim(F.get("__p", F.lit(2)))})
    return out.where(F.col("text") != "").drop("__p")


def read_verses(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Parsed lines; line_no is rising within a file, not gapless."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse_lines(lines, strict=strict).drop("value")


def parse_phoneme_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """text || p1 p2 ... lines as text and tokens."""
    parts = F.split(F.col(value), r" \|\| ", 2)
    return lines.where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("text"), F.split(F.get(parts, F.lit(1)), " ").alias("tokens"))


def list_recordings(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """Files below root: reciter (the leaf folder), file and path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path")
    pieces = F.split("path", "/")
    return files.select(F.element_at(pieces, -2).alias("reciter_name"), F.element_at(pieces, -1).alias("file"), "path")


def surah_of(file: Column) -> Column:
    return F.substring(file, 1, 3)


def ayah_of(file: Column) -> Column:
    return F.substring(file, 4, 3)


def pad3(x: Column) -> Column:
    """Zeros on the left to three places; longer text is left as it is."""
    s = x.cast("string")
    return F.when(F.length(s) >= 3, s).otherwise(F.lpad(s, 3, "0"))


def without_basmala(recordings: DataFrame, file: str = "file", intent: bool = False) -> DataFrame:
    """The recorded filter compares one character with a verse number, so it keeps all rows;
    intent=True leaves out verse numbers 000 and 001."""
    return recordings.where(~ayah_of(F.col(file)).isin("000", "001")) if intent else recordings


def join_verses(recordings: DataFrame, verses: DataFrame, file: str = "file") -> DataFrame:
    """Recordings with their verse's text by the padded key. Of repeated verses the last line
    counts; verses whose last text is empty have no recordings. The verse side is one row
    for each key; Spark broadcasts it while it is small."""
    key = F.concat(pad3(F.col("surah")), pad3(F.col("ayah")))
    last = verses.select(key.alias("key"), "line_no", "text").groupBy("key").agg(F.max_by("text", "line_no").alias("ayah_text")).where(F.col("ayah_text") != "")
    return recordings.withColumn("key", F.concat(surah_of(F.col(file)), ayah_of(F.col(file)))).join(last, "key")


def unpivot_reciters(wide: DataFrame, keys: list[str], reciters: list[str]) -> DataFrame:
    """One row for each recording of a wide table; null and '0.0' mean there is none."""
    text = wide.select(*keys, *[F.col(c).cast("string").alias(c) for c in reciters])
    return text.unpivot(keys, reciters, "reciter_name", "path").where(F.col("path").isNotNull() & (F.col("path") != "0.0"))


def asr_words(results: DataFrame, segments: str = "segments", index: int | None = 3) -> DataFrame:
    """Words with start and end of one segment, or of all with index=None."""
    words = F.flatten(F.transform(segments, lambda s: s["words"])) if index is None else F.get(F.col(segments), F.lit(index))["words"]
    others = [c for c in results.columns if c != segments]
    return results.select(*others, F.posexplode(words).alias("pos", "w")).select(*others, "pos", "w.word", "w.start", "w.end")


# -- sinks ----------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """White space at a field's ends stays, as read_csv keeps it."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_phoneme_lines(df: DataFrame, path: str, text: str = "text", tokens: str = "tokens", compression: str = "none") -> None:
    """Plain lines, or packed ones (gzip), which Spark reads alike; a packed file is read by one task."""
    df.select(F.concat_ws(" || ", F.col(text), F.array_join(tokens, " ")).alias("value")).write.mode("overwrite").text(path, compression=compression)


def write_phoneme_manifest(df: DataFrame, path: str, tokens: str = "tokens") -> None:
    """The manifest's columns and its tokens as a printed list, which parse_list reads."""
    quoted = F.transform(tokens, lambda t: F.concat(F.lit("'"), F.regexp_replace(t, r"(['\\])", r"\\$1"), F.lit("'")))
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    write_csv(df.select(*columns, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("phonemes")), path)


def write_chunks(df: DataFrame, path: str, names: list[str], order: str, line: str) -> None:
    """Contiguous chunks of the rounded-up size, one folder for each name."""
    from recitary.operators.sequence import ceil_chunk
    from recitary.operators.split import ranked_by

    own = ranked_by(df, order)
    chunk = ceil_chunk(F.col("rank") - 1, F.col("total"), len(names))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), chunk + 1)
    own.select(name.alias("assignee"), F.col(line).alias("value")).write.mode("overwrite").partitionBy("assignee").text(path)

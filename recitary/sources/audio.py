"""Recordings as rows: PCM wave files in, wave clips out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recitary.operators.signal import RATE, decode_wav, encode_wav, peak_normalize, preprocess

WAVE = "path string, n_samples int, samples array<float>, error string"
FEATURES = "path string, n_samples int, n_frames int, features array<array<float>>, error string"


def _recordings(spark: SparkSession, root: str) -> DataFrame:
    """Files below root as rows. Spark's reader leaves files without a byte out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")


def read_wav(spark: SparkSession, root: str, rate: int = RATE, normalize: bool = False) -> DataFrame:
    """path, samples (mono at `rate`), n_samples, and error where a file is no PCM wave file:
    one bad file is a row, not a failed job. Other formats need transcoding first."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    x = decode_wav(content, rate)
                    x = peak_normalize(x) if normalize else x
                    rows.append((path, len(x), x.tolist(), None))
                except Exception as e:  # reported in the row
                    rows.append((path, 0, None, f"not a PCM wave file: {e}"))
            yield pd.DataFrame(rows, columns=["path", "n_samples", "samples", "error"])

    return _recordings(spark, root).mapInPandas(decode, WAVE)


def read_features(spark: SparkSession, root: str, rate: int = RATE, chain: Callable[[np.ndarray, int], np.ndarray] = preprocess) -> DataFrame:
    """path, n_samples, n_frames, features (frames by dimensions) and error: each file is decoded, resampled, filtered,
    cleaned, trimmed and turned to normalised cepstra where it is read, so that samples never leave the task. A file that is
    no wave file, or too short for the chain, is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                n = 0
                try:
                    x = decode_wav(content, rate)
                    n = len(x)
                    f = chain(x, rate)
                    rows.append((path, n, len(f), f.tolist(), None))
                except Exception as e:  # reported in the row
                    rows.append((path, n, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "n_samples", "n_frames", "features", "error"])

    return _recordings(spark, root).mapInPandas(run, FEATURES)


def wav_bytes(samples, rate: int = RATE, channels: int = 1):
    """Arrow UDF: samples to a 16-bit wave file's bytes, for a binary column or clip sink."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encode_wav(x, rate, channels) for x in rows])

    return run(samples)


def write_files(df: DataFrame, path: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's bytes to its own file below path, when the result is acted on: (name, n_bytes).
    Names are relative and decide alone where a file goes, so a task that runs again overwrites its own files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        made: set[str] = set()
        for df in batches:
            for file, raw in zip(df["name"], df["content"], strict=True):
                place = f"{root}/{file}"
                parent = place.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(place) as out:
                    out.write(raw)
            yield pd.DataFrame({"name": df["name"], "n_bytes": df["content"].map(len).astype("int64")})

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(write, "name string, n_bytes long")

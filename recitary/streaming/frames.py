"""Frame streams: collapse and segments with state for each utterance.

Frames of one utterance must arrive in order between micro-batches; within one they are
sorted. The state is one open run, whatever the stream's length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN = "id int, start long, frames long, seg int"


def stream_segments(frames: DataFrame, utt: str = "utt", t: str = "t", id_: str = "id", blank: int = 0, idle: str | None = None) -> DataFrame:
    """Closed runs as (utt, seg, id, frames, start). A run is emitted when another id follows, or,
    with `idle` (such as "30 seconds"), when its utterance has been silent for so long."""
    kind = dict(frames.dtypes)[utt]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, start, n, seg = state.get if state.exists else (None, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            if run is not None and run != blank and n:
                out.append((key[0], seg, run, n, start))
            state.remove()
        else:
            every = pd.concat(list(batches)).sort_values(t)
            for at, x in zip(every[t], every[id_], strict=True):
                if n and x == run:
                    n += 1
                    continue
                if n and run != blank:
                    out.append((key[0], seg, run, n, start))
                    seg += 1
                run, start, n = x, at, 1
            state.update((int(run), int(start), int(n), int(seg)))
            if idle:
                state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=[utt, "seg", "id", "frames", "start"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return frames.groupBy(utt).applyInPandasWithState(step, f"{utt} {kind}, seg int, id int, frames long, start long", RUN, "append", timeout)


def windowed_rate(frames: DataFrame, time: str, width: str = "10 seconds", slide: str | None = None, late: str = "30 seconds", utt: str = "utt") -> DataFrame:
    """Frames of each utterance in each time window, late ones admitted up to the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return frames.withWatermark(time, late).groupBy(w, utt).agg(F.count("*").alias("frames")).select(F.col("window.start").alias("start"), utt, "frames")

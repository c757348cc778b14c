"""Detection and masking of streams, and a token bucket for each client as a stateful operator.

Detection has no state: the batch columns run on a stream as they are. A stream's checkpoint folder must be shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import Detector, detect, mask


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New JSON files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def masked_stream(stream: DataFrame, which: str | Detector = "rules", policy: str = "default", salt: bytes | None = None, text_col: str = "text") -> DataFrame:
    """The stream with the masked text in place of the text, and the summary; the text itself goes no further."""
    return mask(stream, which, policy, text_col, "_masked", salt).withColumn(text_col, F.col("_masked")).drop("_masked")


def label_counts(stream: DataFrame, time_col: str, late: str = "10 minutes", window: str = "5 minutes", which: str | Detector = "rules") -> DataFrame:
    """Spans by window and label; events later than the watermark are left out, as streaming aggregation must."""
    found = detect(stream, which).withWatermark(time_col, late)
    each = found.select(time_col, F.explode("spans").alias("s"))
    return each.groupBy(F.window(time_col, window), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Starts a query that handles what is there and ends."""
    return stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def admitted(times: list[float], tokens: float, last: float | None, per_minute: float) -> tuple[list[bool], float, float | None]:
    """Which requests at these times (in order) find a token: the bucket holds ``per_minute`` and fills evenly."""
    out = []
    for t in times:
        if last is not None:
            tokens = min(per_minute, tokens + max(0.0, t - last) * per_minute / 60)
        last = t if last is None else max(t, last)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def rate_limited(stream: DataFrame, key: str, time_col: str, per_minute: float = 20.0, idle: float = 600.0) -> DataFrame:
    """(key, at, allowed) of every request. State is two numbers for each key, dropped after ``idle`` seconds without a request,
    when its bucket has long been full again; a key that comes back starts with a full one."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (per_minute, None)
        times = sorted(t for pdf in batches for t in pdf["at"])
        ok, tokens, last = admitted(times, tokens, last, per_minute)
        state.update((tokens, last))
        state.setTimeoutDuration(int(max(idle, 60.0) * 1000))
        yield pd.DataFrame({"key": [k[0]] * len(ok), "at": times, "allowed": ok})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time_col).cast("timestamp").cast("double").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at double, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)

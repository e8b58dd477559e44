"""The tail of a log as a stream: today's lines without noise, whatever batches they come in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINES = "file string, n long, line string"
#: Of a file: its last line, and its last dated line.
STATE = "upto long, dated string"


def tail(lines: DataFrame, today: str, noise: list[str], keep_ms: int = 2 * 86_400_000) -> DataFrame:
    """``market.todays_log`` of a stream (file, n, line) of logs that only grow, in append mode.

    A line that comes again, or after a later one of its file, is left out.  A file's state goes
    when nothing came for ``keep_ms``; its lines count as today's then until the next date.
    """

    def step(key: Any, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pd.concat(list(rows)).sort_values("n")  # of one file in one batch, whose size the trigger bounds
        upto, dated = state.get if state.exists else (-(1 << 63), None)
        held = held[held["line"].notna() & (held["n"] > upto)].drop_duplicates("n")
        if not held.empty:
            quiet = held[np.array([not any(word in line for word in noise) for line in held["line"]], dtype=bool)]
            text, last = quiet["line"].tolist(), []
            for line in text:
                if line.startswith("[20") and line[5:6] == "-" and len(line) >= 11:
                    dated = line
                last.append(dated)
            state.update((int(held["n"].iloc[-1]), dated))
            kept = [(d is None or today in d) and line.strip() != "" for line, d in zip(text, last, strict=True)]
            yield quiet.loc[np.array(kept, dtype=bool), ["file", "n", "line"]]
        state.setTimeoutDuration(keep_ms)

    return lines.groupBy("file").applyInPandasWithState(step, LINES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def appended(df: DataFrame, folder: str) -> DataFrame:
    """What a stream in append mode has for the data that is there, written under ``folder``.

    Operators with a processing-time timeout would ask for batches without data for ever, so none
    is run here.
    """
    spark: SparkSession = df.sparkSession
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")

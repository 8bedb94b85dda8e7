"""A work queue on a stream: attempts and waiting times of each key in keyed state, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = ("waiting", "retry", "gave_up", "done")


def _advance(key: str, most: int, wait: int, forget: int):
    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, done = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            if done or attempts >= most:
                state.remove()
                return
            state.update((attempts, done))  # without a timer: it is out for another attempt
            yield pd.DataFrame({key: [keys[0]], "attempts": [attempts], "state": ["retry"]})
            return
        rows = pd.concat(list(batches)).sort_values(["at", "ok"])
        last = int(rows["at"].max())
        for ok in rows["ok"]:
            if not done and attempts < most:
                done, attempts = bool(ok), attempts + (not ok)
        state.update((int(attempts), bool(done)))
        over = done or attempts >= most
        state.setTimeoutTimestamp(max(last + (forget if over else wait * 2 ** (int(attempts) - 1)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]], "attempts": [int(attempts)], "state": ["done" if done else "gave_up" if over else "waiting"]})

    return run


def retry_queue(results: DataFrame, key: str, ok: str, at: str, most: int = 5, wait: int = 60, late: str = "1 hour", forget: int = 7 * 24 * 3600) -> DataFrame:
    """Rows (key, attempts, state) of a stream of attempts, each with its time and whether it succeeded.

    A key that failed waits, `wait` seconds after its first failure and twice as
    long after each further one, and then comes back as `retry` when event time
    has passed that. After `most` failures it is given up. A key that is done or
    given up stays so, and is forgotten after `forget` seconds.
    """
    kind = results.schema[key].dataType.simpleString()
    seconds = F.col(at).cast("timestamp")
    rows = results.select(key, F.coalesce(F.col(ok), F.lit(False)).alias("ok"), seconds.alias("_time"), F.unix_millis(seconds).alias("at")).where("_time is not null").withWatermark("_time", late)
    run = _advance(key, most, wait * 1000, forget * 1000)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, attempts int, state string", "attempts int, done boolean", "append", GroupStateTimeout.EventTimeTimeout)

"""Backtest counts that run with a stream: violations and transitions by (series,
model, level), in the order of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.backtests import KEY

COUNTS = "n_obs long, n_violations long, n00 long, n01 long, n10 long, n11 long"
_OUT = "series_id string, model string, alpha double, ts timestamp, " + COUNTS


class _Running(StatefulProcessor):
    """Keeps what has come, by time, until the watermark passes it; then it is
    counted in order. A timer at the earliest kept time does that also when no
    more rows of the key come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS + ", last int")
        self.waiting = handle.getMapState("waiting", "micros long", "hit int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            for micros, hit in zip(pdf["micros"].tolist(), pdf["hit"].tolist()):
                self.waiting.updateValue((micros,), (int(hit),))
                least = micros if least is None else min(least, micros)
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = sorted((m[0], h[0]) for m, h in self.waiting.iterator())
        due = [x for x in kept if x[0] < mark]
        if due:
            n, v, a, b, c, d, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0, 0, -1)
            steps = [a, b, c, d]
            for micros, hit in due:
                n, v = n + 1, v + hit
                if last >= 0:
                    steps[2 * last + hit] += 1
                last = hit
                self.waiting.removeKey((micros,))
            self.counts.update((n, v, *steps, last))
            yield pd.DataFrame([(*key, pd.Timestamp(due[-1][0], unit="us"), n, v, *steps)], columns=[x.split()[0] for x in _OUT.split(", ")])
        rest = kept[len(due):]
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)

    def close(self) -> None:
        pass


def running_counts(forecasts: DataFrame, late: str = "2 days") -> DataFrame:
    """A row (series_id, model, alpha, ts, n_obs, ...) whenever the counts of a
    group move on: those of backtests.counts() over its rows up to ts.

    forecasts: a stream of (series_id, model, alpha, ts, actual_return, var). Rows
    may come out of order by up to `late`; later ones are dropped. Rows without
    both figures count nowhere; one time has one row, the last to come. Needs the
    RocksDB state store; a query that starts again from its checkpoint goes on
    where it was.
    """
    f = forecasts.where("ts is not null and actual_return is not null and var is not null and not isnan(actual_return) and not isnan(var)")
    hit = (F.col("actual_return") < -F.col("var")).cast("int")
    f = f.withWatermark("ts", late).select(*KEY, "ts", F.unix_micros("ts").alias("micros"), hit.alias("hit"))
    return f.groupBy(*KEY).transformWithStateInPandas(_Running(), _OUT, "Append", "EventTime")

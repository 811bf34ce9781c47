"""The running-balance check as a stateful operator: waiting rows in a list, the last balance as a value, timers of event time.

The session needs RocksDB for its state: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEDGER = "doc_id long, row_idx long, expected double, balance double, state string"
WAITING = "row_idx long, t long, flow_in double, flow_out double, balance double"


class LedgerProcessor(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, and are then checked in order against the balance stated before; each row is a list element
    of its own, so that a batch appends what is new. A ledger that is idle for `keep_ms` of event time is forgotten: its next row is a first one."""

    def __init__(self, tolerance: float, keep_ms: int):
        self.tolerance, self.keep_ms = tolerance, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", "balance double, seen boolean, newest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = 0
        for frame in rows:
            for r in frame.itertuples():
                t = int(pd.Timestamp(r.ts).value // 10**6)
                newest = max(newest, t)
                self.waiting.appendValue((int(r.row_idx), t, *(None if pd.isna(v) else float(v) for v in (r.flow_in, r.flow_out, r.balance))))
        balance, seen, before = self.last.get() if self.last.exists() else (None, False, 0)
        self.last.update((balance, seen, max(before or 0, newest)))
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame(columns=["doc_id", "row_idx", "expected", "balance", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        balance, seen, newest = self.last.get() if self.last.exists() else (None, False, 0)
        rows = sorted(tuple(r) for r in self.waiting.get())
        left, out = [r for r in rows if r[1] >= mark], []
        for idx, _, flow_in, flow_out, stated in (r for r in rows if r[1] < mark):
            if seen:
                expected = None if balance is None else balance + (flow_in or 0.0) - (flow_out or 0.0)
                state = "incomplete" if expected is None or stated is None else "failed" if abs(expected - stated) > self.tolerance else "passed"
                out.append((key[0], idx, expected, stated, state))
            balance, seen = stated, True
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(max(r[1] for r in left) + 1)
        elif mark > newest + self.keep_ms:
            self.last.clear()
        else:
            self.handle.registerTimer(newest + self.keep_ms + 1)
        if self.last.exists():
            self.last.update((balance, seen, newest))
        yield pd.DataFrame(out, columns=["doc_id", "row_idx", "expected", "balance", "state"]).astype({"doc_id": "int64", "row_idx": "int64", "expected": "float64", "balance": "float64"})

    def close(self) -> None:
        pass


def ledger_stream(stream: DataFrame, late: str = "10 minutes", tolerance: float = 0.01, keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """LEDGER rows of a stream (doc_id, row_idx, ts, flow_in, flow_out, balance) that may come out of order, each document's as the batch check gives them. Rows that the watermark has passed when they come are left out."""
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = stream.select("doc_id", "row_idx", "ts", number("flow_in"), number("flow_out"), number("balance")).withWatermark("ts", late)
    return rows.groupBy("doc_id").transformWithStateInPandas(LedgerProcessor(tolerance, keep_ms), LEDGER, "Append", "EventTime")

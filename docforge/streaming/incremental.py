"""The same checks on arriving data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def each_batch(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str]):
    """Runs a batch plan on each micro-batch of whole documents and appends its rows as Parquet, by batch.

    A batch that is run again after a failure overwrites its own folder, so that its rows are there once."""

    def run(df: DataFrame, n: int) -> None:
        build(df).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_evidence(stream: DataFrame, fingerprint: str = "fp", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Evidence once for each fingerprint within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([fingerprint])


def outcome_windows(stream: DataFrame, at: str, length: str, late: str, by: str, value: str) -> DataFrame:
    """Counts and sums by window of event time; rows later than `late` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("window.start", "window.end", by, "n", "total")


LEDGER = "doc_id long, row_idx long, expected double, balance double, state string"


def ledger_check(stream: DataFrame, late: str = "10 minutes", tolerance: float = 0.01) -> DataFrame:
    """The running-balance check on rows (doc_id, row_idx, ts, flow_in, flow_out, balance) that may come out of order.

    Rows wait in the ledger's state until the watermark has passed them, then are checked in the order of row_idx against
    the stated balance of the row before; the state holds the waiting rows and the last balance.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames, state: GroupState):
        waiting, last, seen = state.get if state.exists else ("[]", None, False)
        held = pd.read_json(__import__("io").StringIO(waiting), orient="records") if waiting != "[]" else pd.DataFrame()
        new = [f.assign(t=f["ts"].astype("int64") // (10**6 if str(f["ts"].dtype).endswith("[ns]") else 10**3)) for f in frames]
        rows = pd.concat([held, *[f[["row_idx", "t", "flow_in", "flow_out", "balance"]] for f in new]], ignore_index=True) if len(held) or new else held
        mark = state.getCurrentWatermarkMs()
        done = rows[rows["t"] < mark].sort_values("row_idx") if len(rows) else rows
        out = []
        for r in done.itertuples():
            stated = None if pd.isna(r.balance) else float(r.balance)
            if seen:
                expected = None if last is None else last + (0 if pd.isna(r.flow_in) else r.flow_in) - (0 if pd.isna(r.flow_out) else r.flow_out)
                status = "incomplete" if expected is None or stated is None else "failed" if abs(expected - stated) > tolerance else "passed"
                out.append((key[0], int(r.row_idx), expected, stated, status))
            last, seen = stated, True
        left = rows[rows["t"] >= mark] if len(rows) else rows
        state.update((left.to_json(orient="records") if len(left) else "[]", last, seen))
        if len(left):
            state.setTimeoutTimestamp(int(max(left["t"].max(), mark)) + 1)
        yield pd.DataFrame(out, columns=["doc_id", "row_idx", "expected", "balance", "state"])

    cols = stream.select("doc_id", "row_idx", "ts", F.col("flow_in").cast("double").alias("flow_in"), F.col("flow_out").cast("double").alias("flow_out"), F.col("balance").cast("double").alias("balance"))
    return cols.withWatermark("ts", late).groupBy("doc_id").applyInPandasWithState(run, LEDGER, "waiting string, last double, seen boolean", "append", GroupStateTimeout.EventTimeTimeout)

"""The jobs over unbounded tables: pages as they come, changed pages, and circuits per language pair with their state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from glossmill.functions.lang import DEFAULT_TARGET
from glossmill.operators.attempts import OPEN_SECONDS, THRESHOLD
from glossmill.operators.extract import segments
from glossmill.operators.render import fresh

PAGES = "page_id long, url string, html string"


#: Bytes of files that one micro-batch takes, which bound what a key's rows of a batch may need.
BATCH_BYTES = 1 << 30


def table_stream(spark: SparkSession, path: str, schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def segment_stream(pages: DataFrame, target: str = DEFAULT_TARGET) -> DataFrame:
    """The batch plan, which keeps no state, over a stream of pages."""
    return segments(pages, target)


def once(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what there is now, exactly once into Parquet below folder, and reads that. Run again with the same folder, it
    goes on where it ended. Rows that came too late for the watermark would be missing from the result, so they are an error."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    late = late_rows(query)
    if late:
        raise ValueError(f"{late} rows came later than the watermark allows")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped, in the batches whose progress the query still has."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def changed_pages(pages: DataFrame, known: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], folder: str):
    """Starts a stream that hands sink the segments of each batch of pages that `known()` doesn't have yet."""

    def each(batch: DataFrame, number: int) -> None:
        sink(fresh(segments(batch), known()), number)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", folder).trigger(availableNow=True).start()


def settle(state: tuple[int, int], at: int, outcome: str, threshold: int = THRESHOLD, seconds: int = OPEN_SECONDS) -> tuple[tuple[int, int], bool]:
    """(streak and end of the opening after one attempt at `at` microseconds, whether the attempt was rejected)."""
    streak, until = state
    if at < until:
        return state, True
    if outcome == "timeout":
        return (streak + 1, at + seconds * 1_000_000 if streak + 1 >= threshold else until), False
    return ((0, 0) if outcome in ("success", "error") else state), False


class InOrder(StatefulProcessor):
    """The circuit of one pair and entry. Attempts are held as they come until the watermark has passed them, and then count in the
    order of ts and id. A key has one timer: for the first attempt held, or else for the end of its idle time."""

    def __init__(self, threshold: int, seconds: int, idle_ms: int) -> None:
        self.threshold, self.seconds, self.idle_ms = threshold, seconds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, outcome string")
        self.now = handle.getValueState("now", "streak int, until long, done long, last long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = last = None
        for part in rows:
            at = part["at"].to_numpy()
            self.held.appendList(list(zip(at.tolist(), part["id"].tolist(), part["outcome"].tolist(), strict=True)))
            first, last = min(at.min(), at.min() if first is None else first), max(at.max(), at.max() if last is None else last)
        streak, until, done, before, timer = self.now.get() if self.now.exists() else (0, 0, 0, 0, 0)
        held = self.held_until(timer)
        self.set((streak, until, done), max(before, int(last)), timer, int(first) if held is None else min(int(first), held))
        yield pd.DataFrame(columns=OUT)

    def held_until(self, timer: int) -> int | None:
        """The moment of the first attempt held, as the timer says; 0 is no timer, and odd ones are for idle keys."""
        return None if not timer or timer % 2 else timer // 2 * 1000

    def set(self, state: tuple[int, int, int], last: int, timer: int, first: int | None) -> None:
        """Writes the state (streak, opening's end and the last attempt that has counted) and puts the timer where it belongs."""
        due = (last // 1000 + self.idle_ms) if first is None else first // 1000
        due = 2 * due + (first is None)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer // 2)
            self.handle.registerTimer(due // 2)
        self.now.update((*state, last, due))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        streak, until, done, last, _ = self.now.get()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.held.get(), key=lambda r: r[:2]) if self.held.exists() else []
        ready = [r for r in rows if r[0] <= passed]
        out = []
        for at, number, outcome in ready:
            if at - done > self.idle_ms * 1000:
                streak, until = 0, 0
            done = at
            (streak, until), rejected = settle((streak, until), at, outcome, self.threshold, self.seconds)
            out.append((key[0], key[1], number, rejected, streak))
        rest = rows[len(ready) :]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        if rest or last // 1000 + self.idle_ms > passed // 1000:
            self.set((streak, until, done), last, 0, rest[0][0] if rest else None)
        else:
            self.now.clear()
        yield pd.DataFrame(out, columns=OUT)

    def close(self) -> None:
        pass


OUT = ["pair", "entry", "id", "rejected", "streak"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def circuit_stream(attempts: DataFrame, threshold: int = THRESHOLD, seconds: int = OPEN_SECONDS, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """(pair, entry, id, rejected, streak) of a stream of attempts (pair, entry, id, ts, outcome), in event-time order.

    An attempt counts once the watermark, `late` behind the latest, has passed it, whatever batch it came in; the state of a pair holds
    what came meanwhile, and is forgotten when `idle` has passed without an attempt. Attempts later than that are dropped (late_rows counts them).
    This state needs the RocksDB store, which is set for the session.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = attempts.select("pair", "entry", "id", F.col("ts").cast("timestamp").alias("ts"), "outcome").withWatermark("ts", late)
    keyed = rows.withColumn("at", F.unix_micros("ts")).groupBy("pair", "entry")
    processor = InOrder(threshold, seconds, int(pd.Timedelta(idle).total_seconds() * 1000))
    return keyed.transformWithStateInPandas(processor, "pair long, entry string, id long, rejected boolean, streak int", "append", "eventtime")


def with_end(attempts: DataFrame, folder: str) -> DataFrame:
    """A stream of attempts that can be ended: a file that end_stream() puts into folder moves the watermark past all of them."""
    spark = attempts.sparkSession
    spark.createDataFrame([], attempts.schema).write.mode("ignore").parquet(folder)
    return attempts.unionByName(spark.readStream.schema(attempts.schema).parquet(folder))


def end_stream(attempts: DataFrame, folder: str) -> None:
    """Puts one attempt of no pair, far in the future, into folder. Its own row never comes out, as nothing follows it."""
    end = {"ts": F.to_timestamp(F.lit("2260-01-01"))}
    one = attempts.sparkSession.range(1).select(*(end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in attempts.schema))
    one.write.mode("append").parquet(folder)

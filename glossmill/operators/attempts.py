"""Timeouts and outages per language pair, from a log of attempts (pair, entry, id, ts, outcome and, for status queries, result).

outcome: success, error (a real one), timeout or cancelled. A few pairs have nearly all attempts, so the log is dealt by ranges of time
within a pair: each range is worked on by itself, and one row per range carries over what later ranges need.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glossmill.sources.stored import dropped, dropped_later, written

# Timeouts in a row that open the circuit, and for how long.
THRESHOLD, OPEN_SECONDS = 3, 60


def in_ranges(log: DataFrame, *key: str) -> DataFrame:
    """log, written in ranges of (key, ts, id), with part: the range's number. Later reads don't depend on how files are split."""
    order = [*key, "ts", "id"]
    return dropped_later(written(log.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "attempts"))


def timeout_streaks(attempts: DataFrame) -> DataFrame:
    """Attempts that weren't cancelled, with `streak`: timeouts in a row up to here, per pair and entry."""
    rows = in_ranges(attempts.filter("outcome <> 'cancelled'"), "pair", "entry")
    key = ["part", "pair", "entry"]
    timeout = F.when(F.col("outcome") == "timeout", 1).otherwise(0)
    rows = rows.withColumn("replies", F.sum(1 - timeout).over(Window.partitionBy(*key).orderBy("ts", "id")))
    rows = rows.withColumn("own", F.sum(timeout).over(Window.partitionBy(*key, "replies").orderBy("ts", "id")))
    # What a range hands on: its timeouts after its last reply, and those of ranges before it if it has no reply.
    ends = rows.groupBy(*key).agg(F.max("replies").alias("all"), F.max_by("own", F.struct("ts", "id")).alias("trailing"))
    parts = Window.partitionBy("pair", "entry").orderBy("part")
    ends = ends.withColumn("since", F.sum(F.when(F.col("all") > 0, 1).otherwise(0)).over(parts))
    ends = ends.withColumn("handed", F.sum("trailing").over(Window.partitionBy("pair", "entry", "since").orderBy("part")))
    carried = ends.select(*key, F.coalesce(F.lag("handed").over(parts), F.lit(0)).alias("carried"))
    streak = F.col("own") + F.when(F.col("replies") == 0, F.col("carried")).otherwise(0)
    return rows.join(carried, key).select(*attempts.columns, streak.alias("streak"))


def installed_event(attempts: DataFrame) -> Column:
    """True where an answer says that the pair is installed, false for a real translation error, which alone clears that; else null."""
    answer = F.coalesce(F.col("result"), F.lit("installed")) if "result" in attempts.columns else F.lit("installed")
    return F.when((F.col("entry") == "availability") & (F.col("outcome") == "success") & (answer == "installed"), True).when((F.col("entry") == "translate") & (F.col("outcome") == "error"), False)


def installed(attempts: DataFrame) -> DataFrame:
    """Attempts with `cached`: whether the pair is known as installed after them."""
    rows = in_ranges(attempts.withColumn("event", installed_event(attempts)), "pair")
    before = Window.partitionBy("part", "pair").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("event", ignorenulls=True).over(before))
    ends = rows.groupBy("part", "pair").agg(F.max_by("own", F.struct("ts", "id")).alias("end"))
    earlier = Window.partitionBy("pair").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", "pair", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    return rows.join(carried, ["part", "pair"]).select(*attempts.columns, F.coalesce("own", "carried", F.lit(False)).alias("cached"))


#: What becomes of the circuit between two places in a log: rejected attempts, openings, whether a reply ended what was before, timeouts
#: since that reply or the first place, the moment until which the last of the openings lasts, and how many timeouts a new opening needs
#: less than the threshold.
EFFECTS = ["rejected", "opened", "reset", "streak", "until", "level"]


def folded(log: DataFrame, threshold: int, wait: int) -> DataFrame:
    """What each range of the log does to the circuit, from every place where a live attempt may come first in it.

    One row per place (part, pair, entry, behind, level): behind counts the range's attempts of the key after it, level the timeouts that
    count when it is reached. A range is read from its end, as what follows an attempt is known then; only the attempts of one opening's
    length are held. Of keys that begin in the range the first attempt is the only place; a key that may go on from an earlier range can
    be entered at its first attempt, at any level, or right after an opening, at any attempt of its first `wait` microseconds.
    """
    names = ["part", "pair", "entry", "behind", "level", "size", "at", "first_at", "last_at", *(f"to_{c}" for c in EFFECTS)]
    kinds = [T.IntegerType(), log.schema["pair"].dataType, log.schema["entry"].dataType, T.LongType(), T.IntegerType(), *[T.LongType()] * 6, T.BooleanType(), *[T.LongType()] * 2, T.IntegerType()]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])
    types = to_arrow_schema(schema)
    top = threshold - 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), None
        for batch in batches:
            done: list[tuple] = []
            for pair, entry, at, outcome in zip(*(batch.column(c).to_pylist() for c in ("pair", "entry", "at", "outcome")), strict=True):
                if run is None or run.key != (pair, entry):
                    if run is not None:
                        done.append(run.start())
                    run = Run((pair, entry), top, wait)
                run.back(at, outcome)
            yield rows(part, done)
        if run is not None:
            for at in range(0, len(places := run.places()), 10_000):
                yield rows(part, places[at : at + 10_000])

    def rows(part: int, found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(found), types[0].type), *(pa.array([r[k] for r in found], f.type) for k, f in enumerate(list(types)[1:]))], names)

    order = ["pair", "entry", "ts", "id", "outcome"]
    ranges = log.repartitionByRange(*order).sortWithinPartitions(*(F.col(c).desc() for c in order))
    return ranges.select("pair", "entry", "at", "outcome").mapInArrow(fold, schema)


class Run:
    """The attempts of one key in one range, added from the last to the first."""

    def __init__(self, key: tuple, top: int, wait: int) -> None:
        self.key, self.top, self.wait, self.size, self.last_at = key, top, wait, 0, None
        #: The effect of the attempts so far, by level at the first of them, and the attempts that an opening may lead to: (at, behind, effect).
        self.ways: list[tuple] = [(0, 0, False, 0, None, c) for c in range(top + 1)]
        self.ahead: deque[tuple] = deque()
        self.at: int | None = None

    def back(self, at: int | None, outcome: str) -> None:
        """Adds the attempt before those that were added."""
        self.last_at = at if not self.size else self.last_at
        if outcome == "timeout":
            # A timeout at the top level opens the circuit; without a moment the opening rejects nothing.
            opening = self.landed(at) if at is not None else (self.ways[self.top], 0, None)
            self.ways = [counted(w) for w in self.ways[1:]] + [opened(*opening)]
        elif outcome in ("success", "error"):
            rejected, n, _, streak, until, level = self.ways[0]
            self.ways = [(rejected, n, True, streak, until, level)] * (self.top + 1)
        self.at = at
        if at is not None:
            self.ahead.appendleft((at, self.size, self.ways[self.top]))
        self.size += 1

    def landed(self, at: int) -> tuple:
        """(effect of what follows an opening at `at`, attempts that it rejects before, its end)."""
        until = at + self.wait
        while len(self.ahead) > 1 and self.ahead[-2][0] >= until:
            self.ahead.pop()
        if self.ahead and self.ahead[-1][0] >= until:
            return self.ahead[-1][2], self.size - self.ahead[-1][1] - 1, until
        return (0, 0, False, 0, None, self.top), self.size, until

    def place(self, at: int | None, behind: int, level: int, way: tuple) -> tuple:
        return (*self.key, behind, level, self.size, at, self.at, self.last_at, *way)

    def start(self) -> tuple:
        return self.place(self.at, self.size - 1, 0, self.ways[0])

    def places(self) -> list[tuple]:
        if self.at is not None:
            self.landed(self.at)  # drops what no earlier opening leads to
        later = [self.place(at, behind, self.top, way) for at, behind, way in self.ahead if behind < self.size - 1]
        return [self.place(self.at, self.size - 1, c, way) for c, way in enumerate(self.ways)] + later


def counted(way: tuple) -> tuple:
    """A timeout before what `way` does."""
    rejected, n, reset, streak, until, level = way
    return rejected, n, reset, streak if reset else streak + 1, until, level


def opened(way: tuple, skipped: int, until: int | None) -> tuple:
    """A timeout that opens the circuit, and the attempts that it rejects, before what `way` does."""
    rejected, n, reset, streak, own, level = way
    return rejected + skipped, n + 1, reset, streak if reset else streak + 1, own if reset or n else until, level


def then(first: str, second: str) -> list[Column]:
    """Column forms of one effect after the other; a missing second one changes nothing. Names: `first`_rejected and so on."""
    a, b = ({c: F.col(f"{x}_{c}") for c in EFFECTS} for x in (first, second))
    none = b["level"].isNull()
    own = b["reset"] | (b["opened"] > 0)
    joined = {
        "rejected": a["rejected"] + b["rejected"], "opened": a["opened"] + b["opened"], "reset": a["reset"] | b["reset"],
        "streak": F.when(b["reset"], b["streak"]).otherwise(a["streak"] + b["streak"]), "until": F.when(own, b["until"]).otherwise(a["until"]), "level": b["level"],
    }
    return [F.when(none, a[c]).otherwise(joined[c]).alias(f"{first}_{c}") for c in EFFECTS]


def linked(places: DataFrame, runs: DataFrame, top: int) -> DataFrame:
    """places with the one where a live attempt comes next, (next_part, next_behind, next_level), null where the log ends before; the
    attempts of later ranges that are rejected on the way are added.

    runs has one row per key that several ranges hold: its ranges in order, in an array. There are at most two such entries per range.
    """
    later = F.filter("runs", lambda r: r["part"] > F.col("part"))
    reached = F.get(F.filter(later, lambda r: F.col("to_until").isNull() | (r["last_at"] >= F.col("to_until"))), F.lit(0))
    passed = F.aggregate(F.filter(later, lambda r: F.col("home").isNull() | (r["part"] < F.col("home"))), F.lit(0).cast("long"), lambda n, r: n + r["size"])
    exits = places.join(F.broadcast(runs), "key").withColumn("home", reached["part"]).withColumn("first", reached["size"] - 1)
    exits = exits.withColumn("to_rejected", F.col("to_rejected") + F.when(F.col("to_until").isNotNull(), passed).otherwise(0)).drop("runs")
    # The first attempt at or after the opening's end, among the places of the range in which it lies.
    entered = places.filter((F.col("level") == top) & F.col("at").isNotNull()).select("key", "part", "at", F.lit(0).alias("exit"), "behind")
    marks = exits.filter("home is not null and to_until is not null").select("key", F.col("home").alias("part"), F.col("to_until").alias("at"), F.lit(1).alias("exit"), F.lit(None).cast("long").alias("behind")).distinct()
    before = Window.partitionBy("key", "part").orderBy(F.desc("at"), "exit", "behind")
    found = entered.unionByName(marks).withColumn("hit", F.last("behind", ignorenulls=True).over(before)).filter("exit = 1")
    joined = exits.join(found.select("key", F.col("part").alias("home"), F.col("at").alias("to_until"), "hit"), ["key", "home", "to_until"], "left")
    return joined.select(
        "key", "part", "behind", "level", "start", F.col("home").alias("next_part"), F.coalesce("hit", "first").alias("next_behind"), F.when(F.col("home").isNotNull(), F.col("to_level")).alias("next_level"),
        (F.col("to_rejected") + F.coalesce(F.col("first") - F.col("hit"), F.lit(0))).alias("to_rejected"), *(f"to_{c}" for c in EFFECTS[1:]),
    )


def circuit(attempts: DataFrame, threshold: int = THRESHOLD, seconds: int = OPEN_SECONDS) -> DataFrame:
    """Per pair and entry: attempts, rejected ones, openings, the streak and the moment until which the circuit is open, if any.

    The log is dealt in ranges and read once: each range tells what it does to the circuit from any place where it may be entered. Where
    a key's log goes on in other ranges, these steps are put together by pointer doubling, so that n ranges take log n joins of tables
    that hold the attempts of one opening's length per range, however long an outage is.
    """
    log = attempts.select("pair", "entry", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "id", "outcome")
    places = dropped_later(written(folded(log, threshold, seconds * 1_000_000), "places")).withColumn("key", F.to_json(F.struct("pair", "entry")))
    first = (F.col("behind") == F.col("size") - 1) & (F.col("level") == 0)
    effects = [f"to_{c}" for c in EFFECTS]
    whole = places.filter(first).groupBy("pair", "entry").agg(F.sum("size").alias("attempts"), F.array_sort(F.collect_list(F.struct("part", "size", "last_at", *effects))).alias("runs"))
    runs = dropped_later(written(whole.withColumn("key", F.to_json(F.struct("pair", "entry"))), "runs"))
    several = runs.filter("size(runs) > 1")
    longest = several.agg(F.max(F.size("runs"))).first()[0] or 1
    done = runs.filter("size(runs) = 1").select("pair", "entry", "attempts", F.get("runs", F.lit(0)).alias("r")).select("pair", "entry", "attempts", *(f"r.{c}" for c in effects))
    if longest > 1:
        begun = several.select("key", F.get("runs", F.lit(0))["part"].alias("begun"))
        own = places.join(F.broadcast(begun), "key").withColumn("start", first & (F.col("part") == F.col("begun"))).drop("begun")
        steps = written(linked(own, several.select("key", "runs"), threshold - 1), "steps")
        for _ in range((longest - 1).bit_length()):
            doubled = written(twice(steps), "steps")
            dropped(steps)
            steps = doubled
        ended = dropped_later(steps).filter("start").join(several.select("key", "pair", "entry", "attempts"), "key")
        done = done.unionByName(ended.select(*done.columns))
    counts = [F.col(c).cast("int").alias(c.removeprefix("to_")) for c in ("attempts", "to_rejected", "to_opened", "to_streak")]
    return done.select("pair", "entry", *counts, F.timestamp_micros("to_until").alias("open_until"))


def twice(steps: DataFrame) -> DataFrame:
    """Steps twice as long: each followed by that from the place to which it leads."""
    place = ["part", "behind", "level"]
    further = steps.select("key", *(F.col(c).alias(f"next_{c}") for c in place), *(F.col(f"to_{c}").alias(f"on_{c}") for c in EFFECTS), *(F.col(f"next_{c}").alias(f"then_{c}") for c in place))
    joined = steps.join(further, ["key", *(f"next_{c}" for c in place)], "left")
    return joined.select("key", *place, "start", *(F.col(f"then_{c}").alias(f"next_{c}") for c in place), *then("to", "on"))


def resolved_status(attempts: DataFrame, circuits: DataFrame, at: Column) -> DataFrame:
    """Per pair: installed where that is known, undetermined where the status query's circuit is open at `at` or its last attempt had no
    answer, else that answer. Plain aggregates: no pair's log is gathered."""
    order = F.struct("ts", "id")
    known = attempts.withColumn("event", installed_event(attempts)).groupBy("pair").agg(F.max_by("event", F.when(F.col("event").isNotNull(), order)).alias("cached"))
    last = attempts.filter("entry = 'availability'").groupBy("pair").agg(F.max_by(F.struct("outcome", "result"), order).alias("answer"))
    opened = circuits.filter("entry = 'availability'").select("pair", F.coalesce(F.col("open_until") > at, F.lit(False)).alias("open"))
    unanswered = F.coalesce(F.col("answer.outcome") != "success", F.lit(True))
    status = F.when(F.col("cached"), "installed").when(F.coalesce("open", F.lit(False)) | unanswered, "undetermined").otherwise(F.col("answer.result"))
    return known.join(last, "pair", "left").join(opened, "pair", "left").select("pair", status.alias("status"))

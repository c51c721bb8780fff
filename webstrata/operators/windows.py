"""Date windows of index requests: months, halves, smaller parts, windows cut until they fit, joined micro windows, split and backoff rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webstrata.storage import written

#: Windows whose end is at least so many seconds after their start are cut into parts of so many seconds.
LADDER = (
    (5_184_000, 2_592_000), (691_200, 604_800), (172_800, 86_400), (43_200, 21_600), (7_200, 3_600), (1_800, 900), (600, 300), (120, 60), (30, 15), (10, 5), (2, 1),
)
#: Shortest range that is halved, halvings without a response, least page size, windows that are joined again.
HALVED, HALVINGS, LEAST_PAGE = 28 * 86_400, 5, 100
TINY, RUN, JOINED = 5, 8, 3600
STAMP = "yyyyMMddHHmmss"


def seconds(stamp: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(stamp, F.lit(STAMP)))


def stamp(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), STAMP)


def months(ranges: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """(keys, start, end): the calendar months of each range, the first and last cut to it."""
    a, b = F.try_to_timestamp(low, F.lit(STAMP)), F.try_to_timestamp(high, F.lit(STAMP))
    rows = ranges.select(*keys, low, high, F.explode(F.sequence(F.trunc(a.cast("date"), "MM"), F.trunc(b.cast("date"), "MM"), F.expr("interval 1 month"))).alias("m"))
    first, last = F.date_format("m", "yyyyMMdd000000"), F.date_format(F.last_day("m"), "yyyyMMdd235959")
    return rows.select(*keys, F.greatest(first, low).alias("start"), F.least(last, high).alias("end"))


def step_of(length: Column) -> Column:
    """The size of the parts of a window by the seconds from its start to its end; null where it is not cut."""
    out = F.lit(None).cast("long")
    for least, step in reversed(LADDER):
        out = F.when(length >= least, F.lit(step).cast("long")).otherwise(out)
    return out


def split(ranges: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """(keys, start, end): each range cut into the parts of its length's step; a range of two seconds or one stays."""
    a, b = seconds(F.col(low)), seconds(F.col(high))
    rows = ranges.select(*keys, a.alias("a"), b.alias("b")).withColumn("s", F.coalesce(step_of(F.col("b") - F.col("a")), F.col("b") - F.col("a") + 1))
    parts = rows.select(*keys, "b", "s", F.explode(F.sequence("a", "b", "s")).alias("p"))
    return parts.select(*keys, stamp(F.col("p")).alias("start"), stamp(F.least(F.col("p") + F.col("s") - 1, F.col("b"))).alias("end"))


def halves(ranges: DataFrame, keys: list[str], low: str, high: str, least: int = HALVED) -> DataFrame:
    """Two halves of the ranges that are long enough."""
    a, b = seconds(F.col(low)), seconds(F.col(high))
    rows = ranges.select(*keys, a.alias("a"), b.alias("b")).where(F.col("b") - F.col("a") >= least).withColumn("m", F.floor((F.col("a") + F.col("b")) / 2))
    parts = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct((F.col("m") + 1).alias("x"), F.col("b").alias("y"))))
    return rows.select(*keys, parts.alias("p")).select(*keys, stamp(F.col("p.x")).alias("start"), stamp(F.col("p.y")).alias("end"))


def _until_fit(ranges: DataFrame, events: DataFrame, keys: list[str], low: str, high: str, at: str, most: int, step: Callable[[Column, Column], Column], rounds: int, halve_page: bool) -> DataFrame:
    """Rounds of counting and cutting. Each event knows its window, so its next window is arithmetic and no range is joined.

    The windows of a round are those that failed in the last one, cut; the events go along only where their window failed.
    """
    windows = ranges.select(*keys, seconds(F.col(low)).alias("a"), seconds(F.col(high)).alias("b"), "page_size", F.lit(0).alias("depth"))
    times = events.select(*keys, seconds(F.col(at)).alias("t"))
    own = times.join(windows.select(*keys, "a", "b"), keys).where((F.col("t") >= F.col("a")) & (F.col("t") <= F.col("b"))).select(*keys, "t", "a")
    done = None
    for turn in range(rounds + 1):
        counts = own.groupBy(*keys, "a").agg(F.count("*").alias("n"))
        judged = windows.join(counts, [*keys, "a"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("step", step(F.col("a"), F.col("b")))
        fails = (F.col("n") > most) & F.col("step").isNotNull() if turn < rounds else F.lit(False)
        judged = written(judged.withColumn("fails", fails), "windows")
        good = judged.where("not fails").drop("step", "fails")
        done = good if done is None else done.unionByName(good)
        failing = judged.where("fails")
        if failing.isEmpty():
            break
        page = F.greatest(F.lit(LEAST_PAGE), F.floor(F.col("page_size") / 2).cast("int")) if halve_page else F.col("page_size")
        parts = failing.select(*keys, "b", "step", page.alias("page_size"), (F.col("depth") + 1).alias("depth"), F.explode(F.sequence("a", "b", "step")).alias("a"))
        own = own.join(failing.select(*keys, "a", "step"), [*keys, "a"])
        own = written(own.select(*keys, "t", (F.col("a") + F.floor((F.col("t") - F.col("a")) / F.col("step")) * F.col("step")).alias("a")), "placed")
        windows = parts.select(*keys, "a", F.least(F.col("a") + F.col("step") - 1, F.col("b")).alias("b"), "page_size", "depth")
    return done.select(*keys, stamp(F.col("a")).alias("start"), stamp(F.col("b")).alias("end"), "page_size", "depth", "n")


def split_until_fit(ranges: DataFrame, events: DataFrame, keys: list[str], low: str, high: str, at: str, most: int) -> DataFrame:
    """(keys, start, end, page_size, depth, n): each range cut by the ladder until no window holds more than ``most`` events or can be cut.

    ranges: keys, bounds and ``page_size``, which each cut halves; ranges of one key do not overlap. Windows cover each range
    without overlap, those without events too. Events with a null key or outside all ranges count nowhere.
    """
    return _until_fit(ranges, events, keys, low, high, at, most, lambda a, b: step_of(b - a), len(LADDER), True)


def bisect_until_fit(ranges: DataFrame, events: DataFrame, keys: list[str], low: str, high: str, at: str, most: int, rounds: int = HALVINGS) -> DataFrame:
    """As ``split_until_fit``, by halves of windows of at least 28 days, at most ``rounds`` times; the page size stays."""
    half = lambda a, b: F.when(b - a >= HALVED, F.floor((b - a) / 2) + 1)
    return _until_fit(ranges, events, keys, low, high, at, most, half, rounds, False)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of small windows, each where the last one ends and as long as it, as one row with their number ``n``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        number = lambda c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
        a, b, small = number("a"), number("b"), batch.column("small").to_numpy(zero_copy_only=False)
        on = small[1:] & small[:-1] & (a[1:] == b[:-1] + 1) & (b[1:] - a[1:] == b[:-1] - a[:-1])
        for name in set(batch.schema.names) - {"a", "b", "small", "n"}:
            x, y = batch.column(name)[1:], batch.column(name)[:-1]
            try:
                same = pc.or_kleene(pc.equal(x, y), pc.and_(x.is_null(), y.is_null())).fill_null(False).to_numpy(zero_copy_only=False)
            except pa.ArrowNotImplementedError:  # of nested types
                same = np.array([u == v for u, v in zip(x.to_pylist(), y.to_pylist(), strict=True)], bool)
            on = on & same
        first = np.flatnonzero(np.concatenate([[True], ~on]))
        n = pa.array(np.diff(np.append(first, batch.num_rows)), pa.int64())
        taken = batch.take(pa.array(first))
        yield pa.RecordBatch.from_arrays([n if name == "n" else taken.column(name) for name in batch.schema.names], schema=batch.schema)


def joined_micro(ranges: DataFrame, keys: list[str], start: str, end: str, *, untouched: Column | None = None, state: list[str] = (), tiny: int = TINY, least: int = RUN, most: int = JOINED) -> DataFrame:
    """Runs of at least ``least`` adjacent windows of up to ``tiny`` seconds as windows of up to ``most`` seconds; others as they are.

    Bounds are stamps, or seconds as numbers; those of the result are stamps. untouched: whether a window has neither cursor nor
    page nor failure (null: not); windows join only where all of ``state`` agrees. A run takes windows, in order, as long as it stays within ``most``. Before rows are dealt by key, neighbouring ones become stretches
    of equal windows; the stretches of a key are read once in order. Held are at most ``least`` windows and the stretches that overlap.
    """
    free = F.coalesce(untouched if untouched is not None else F.lit(True), F.lit(False))
    names = [*keys, *state]
    bound = lambda c: seconds(F.col(c)) if isinstance(ranges.schema[c].dataType, StringType) else F.col(c).cast("long")
    rows = ranges.select(*names, bound(start).alias("a"), bound(end).alias("b"), free.alias("free"))
    rows = rows.select(*names, "a", "b", F.coalesce(F.col("free") & (F.col("b") - F.col("a")).between(0, tiny), F.lit(False)).alias("small"), F.lit(1).cast("long").alias("n"))
    never = float("inf")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the run's first windows
        count, of, begin, last, out = 0, None, 0, 0, []
        heap: list[tuple] = []  # stretches that begin no later than what was read
        key, order = None, 0

        def close() -> None:
            nonlocal held, count, of
            out.extend([(*of, begin, last)] if count >= least else [(*of, a, b) for a, b in held])
            held, count, of = [], 0, None

        def take(who: list, a: int, b: int, n: int) -> None:
            """Add n windows as long as the one from a to b, one behind the other."""
            nonlocal held, count, of, begin, last
            step = b - a + 1
            while n:
                fit = (begin + most - b) // step + 1 if count and of == who and last + 1 == a else 0
                if fit < 1:
                    close_if_any()
                    of, begin = who, a
                    fit = max(1, (begin + most - b) // step + 1)
                m = min(n, fit)
                held += [(a + k * step, b + k * step) for k in range(min(m, least - len(held)))]
                count, last, n = count + m, b + (m - 1) * step, n - m
                a, b = a + m * step, b + m * step

        def close_if_any() -> None:
            if count:
                close()

        def drain(upto: tuple) -> None:
            """Read the windows before a place, in order of begin and end."""
            nonlocal order
            while heap and heap[0][:2] < upto[:2]:
                a, b, _, who, real, n, small = heappop(heap)
                if not small:
                    close_if_any()
                    out.append((*who, *real))
                    continue
                stop = min(upto[0], heap[0][0] if heap else never)
                m = n if stop == never else max(1, min(n, int(-((a - stop) // (b - a + 1)))))
                take(who, a, b, m)
                if m < n:
                    far, order = m * (b - a + 1), order + 1
                    heappush(heap, (a + far, b + far, order, who, (a + far, b + far), n - m, True))

        for part in parts:
            columns = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in [*names, "a", "b", "n", "small"]]
            for *who, a, b, n, small in zip(*columns, strict=True):
                place = (-never if a is None else int(a), -never if b is None else int(b))
                if key != who[: len(keys)]:
                    drain((never, never))
                    key = who[: len(keys)]
                drain(place)
                order += 1
                heappush(heap, (*place, order, who, (a, b), int(n), bool(small)))
            yield pd.DataFrame(out, columns=[*names, "a", "b"])
            out.clear()
        drain((never, never))
        close_if_any()
        yield pd.DataFrame(out, columns=[*names, "a", "b"])

    schema = rows.select(*names, "a", "b").schema
    found = rows.mapInArrow(_stretches, rows.schema).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "a", "b").mapInPandas(run, schema)
    return found.select(*names, stamp(F.col("a")).alias(start), stamp(F.col("b")).alias(end))


#: Statuses of an outage, which smaller windows do not mend.
OUTAGE = (408, 425, 429, 500, 502, 503, 504)


def may_split(cursor: Column, status: Column, size_pressure: Column, query_related: Column, length: Column) -> Column:
    """Whether a failed window may be cut: never with a cursor or in an outage; always when its response was too large; for other
    failures that the query may have caused (time-outs, broken answers) from half an hour on."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(F.coalesce(cursor, F.lit("")) != "", False).when(yes(status.isin(*OUTAGE)), False).when(yes(size_pressure), True).otherwise(yes(query_related) & yes(length >= 1800))


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.lit(12), F.greatest(attempt - 1, F.lit(0)))))

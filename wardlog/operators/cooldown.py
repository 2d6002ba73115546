"""Alert cool-down: keep an attack iff the last kept one of its key is at least `gap` ago.

The rule is greedy, so whether a row is kept depends on the rows kept before it. Time is cut into
segments. A segment changes the state only from "blocked until x" to "blocked until y", and that is
a step function with few steps, because at most one row per gap is kept and late paths merge. Pass
one computes the function of every (key, segment) on its own. Functions of neighbouring segments are
composed in groups of a fixed number, level by level, and the states are handed down the same
levels. Pass two marks the kept rows. A task therefore holds one segment, or one group of
functions, of one key, however long a flood lasts. The width follows the busiest stretch of the
log; a log that fits in one segment needs pass two only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.session import stage

GAP_SECONDS = 10
SEGMENT_ROWS = 1_000_000
FAN_OUT = 64
UNBLOCKED = np.iinfo(np.int64).min
STEPS = "_key string, _segment bigint, _upto array<bigint>, _exit array<bigint>"

Columns = dict[str, np.ndarray]


def kept_positions(times: np.ndarray, gap: int, blocked_until: int) -> list[int]:
    """Positions kept in sorted times, one search per kept row."""
    kept = []
    at = int(np.searchsorted(times, blocked_until))
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return kept


def segment_steps(times: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment's state function over sorted distinct times, as (upto, exit) steps.

    A state blocked until x <= upto (and above the previous step) leaves the segment blocked
    until `exit`; a state beyond the last step passes through. A state entering at `start` is
    never beyond `start + gap`, so one step past that is enough.
    """
    count = len(times)
    following = np.searchsorted(times, times + gap)
    last = np.where(following < count, following, np.arange(count))
    # Each round doubles the number of kept rows that a path jumps over, until all are at the last one.
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    leave = times[last] + gap
    entries = min(int(np.searchsorted(times, start + gap)) + 1, count)
    return merge_steps(times[:entries], leave[:entries])


def merge_steps(upto: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step for every run of equal exits."""
    last = np.append(leave[1:] != leave[:-1], True)
    return upto[last], leave[last]


def advance(states: np.ndarray, upto: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """States after a segment."""
    at = np.searchsorted(upto, states)
    return np.where(at < len(upto), leave[np.minimum(at, len(leave) - 1)], states)


def compose(functions: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The state function of consecutive segments."""
    upto, states = functions[0]
    if len(functions) > 1:
        # States beyond the first segment's steps meet the second one unblocked.
        upto = np.append(upto, functions[1][0][0])
        states = np.append(states, functions[1][0][0])
    for later in functions[1:]:
        states = advance(states, *later)
    return merge_steps(upto, states)


def sorted_runs(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[list[Columns]]:
    """Complete groups of a partition sorted by `group`, a list of them per incoming batch.

    The parts of a group that goes on over several batches are joined once, when it ends.
    """
    open_parts: list[Columns] = []

    def closed() -> Columns:
        return {name: np.concatenate([part[name] for part in open_parts]) for name in open_parts[0]}

    for batch in batches:
        if batch.empty:
            continue
        columns = {name: batch[name].to_numpy() for name in batch.columns}
        changed = np.zeros(len(batch) - 1, dtype=bool)
        for name in group:
            changed |= columns[name][1:] != columns[name][:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
        parts = [{n: v[a:b] for n, v in columns.items()} for a, b in zip(cuts[:-1], cuts[1:])]
        done = []
        if open_parts and any(open_parts[-1][name][-1] != parts[0][name][0] for name in group):
            done.append(closed())
            open_parts = []
        open_parts.append(parts[0])
        if len(parts) > 1:
            done += [closed(), *parts[1:-1]]
            open_parts = [parts[-1]]
        yield done
    if open_parts:
        yield [closed()]


def map_groups(df: DataFrame, group: list[str], order: str, work: Callable[[Columns], Columns], schema: str) -> DataFrame:
    """Applies `work` to every group, ordered, many small groups per Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in sorted_runs(batches, group):
            if groups:
                results = [work(columns) for columns in groups]
                yield pd.DataFrame({name: [x for r in results for x in r[name]] for name in results[0]})

    return df.repartition(*group).sortWithinPartitions(*group, order).mapInPandas(run, schema)


def _functions(rows: Columns) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(u), np.asarray(e)) for u, e in zip(rows["_upto"], rows["_exit"])]


def _parent(df: DataFrame) -> DataFrame:
    return df.withColumn("_parent", F.floor(F.col("_segment") / FAN_OUT).cast("bigint"))


def _compose_level(functions: DataFrame) -> DataFrame:
    """State functions of groups of FAN_OUT consecutive segments."""

    def combine(rows: Columns) -> Columns:
        upto, leave = compose(_functions(rows))
        return {"_key": rows["_key"][:1], "_segment": rows["_parent"][:1], "_upto": [upto], "_exit": [leave]}

    return map_groups(_parent(functions), ["_key", "_parent"], "_segment", combine, STEPS)


def _entry_states(functions: DataFrame, parents: DataFrame | None) -> DataFrame:
    """State every segment starts in, given the states its parent group starts in."""

    def walk(rows: Columns) -> Columns:
        state = rows["_blocked"][:1]
        blocked = []
        for upto, leave in _functions(rows):
            blocked.append(int(state[0]))
            state = advance(state, upto, leave)
        return {"_key": rows["_key"], "_segment": rows["_segment"], "_blocked": blocked}

    if parents is None:
        started = functions.withColumn("_parent", F.lit(0)).withColumn("_blocked", F.lit(int(UNBLOCKED)).cast("bigint"))
    else:
        started = _parent(functions).join(parents.withColumnRenamed("_segment", "_parent"), ["_key", "_parent"])
    return map_groups(started, ["_key", "_parent"], "_segment", walk, "_key string, _segment bigint, _blocked bigint")


def _segment_width(df: DataFrame, gap: int, segment_rows: int) -> tuple[int, int, int]:
    """Segment width in microseconds, and the first and last instant.

    No stretch of one gap holds more rows than the busiest, so the width keeps a segment near
    `segment_rows`; it never drops below two gaps.
    """
    slots = df.groupBy(F.floor(F.col("_us") / F.lit(gap)).alias("slot")).agg(
        F.count("*").alias("n"), F.min("_us").alias("low"), F.max("_us").alias("high")
    )
    busiest, low, high = slots.agg(F.max("n"), F.min("low"), F.max("high")).first()
    if busiest is None:
        return 2 * gap, 0, 0
    return gap * max(2, segment_rows // busiest), low, high


def alert_cooldown(
    df: DataFrame,
    ts: str,
    ids: list[str],
    key: str | None = None,
    gap_seconds: int = GAP_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Rows of `df` that raise an alert. Order is (ts, ids); without `key` the cool-down is global.

    Rows without a time have no place in the order; they raise no alert and hold none back.
    """
    gap = gap_seconds * 1_000_000
    timed = df.where(F.col(ts).cast("timestamp").isNotNull()).withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")).withColumn(
        "_us", F.unix_micros(F.col(ts).cast("timestamp"))
    )
    width, low, high = _segment_width(timed.select("_us"), gap, segment_rows)
    segment = F.floor((F.col("_us") - F.lit(low)) / F.lit(width)).cast("bigint")
    keyed = timed.withColumn("_segment", segment)
    times = keyed.select("_key", "_segment", "_us").distinct()

    def steps(rows: Columns) -> Columns:
        start = low + int(rows["_segment"][0]) * width
        upto, leave = segment_steps(rows["_us"], start, gap)
        return {"_key": rows["_key"][:1], "_segment": rows["_segment"][:1], "_upto": [upto], "_exit": [leave]}

    def mark(rows: Columns) -> Columns:
        kept = kept_positions(rows["_us"], gap, int(rows["_blocked"][0]))
        return {name: rows[name][kept] for name in ("_key", "_segment", "_us")}

    span = (high - low) // width + 1
    if span == 1:
        waiting = times.withColumn("_blocked", F.lit(int(UNBLOCKED)).cast("bigint"))
    else:
        levels = [map_groups(times, ["_key", "_segment"], "_us", steps, STEPS)]
        if span > FAN_OUT:
            levels = [stage(levels[0], "cooldown-steps")]
        while span > FAN_OUT:
            levels.append(_compose_level(levels[-1]))
            span = -(-span // FAN_OUT)
        entries = _entry_states(levels[-1], None)
        for functions in reversed(levels[:-1]):
            entries = _entry_states(functions, entries)
        waiting = times.join(entries, ["_key", "_segment"])
    kept = map_groups(waiting, ["_key", "_segment"], "_us", mark, "_key string, _segment bigint, _us bigint")
    # Of the rows of a kept instant only the first is kept.
    first = F.min_by(F.struct(*df.columns), F.struct(*ids)).alias("_row")
    return keyed.join(kept, ["_key", "_segment", "_us"]).groupBy("_key", "_segment", "_us").agg(first).select("_row.*")

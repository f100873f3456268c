"""Keyed state of the engine: what a live feature row needs of its actor's past.

``LastEvents`` and ``EpisodeAlerts`` are stateful processors for ``transformWithState``: the engine keeps,
versions, checkpoints and restores their state (in RocksDB) and hands each key its new rows. What a
feature means stays in one place: conditions and values are columns computed before the state, ratios and
flags are columns computed after it, both by ``operators.windows``; the processor only adds up the last rows.

The rows that one micro-batch has for one key are put in time order in memory, so a source should bound
its micro-batches (``maxFilesPerTrigger``). An event that comes late takes its place in time among the
actor's last events; rows emitted before are not revised.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tracewell.functions import constants as K
from tracewell.functions.scalars import severity_band
from tracewell.operators import windows as W
from tracewell.operators.rules import window_signals

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_engine_state(spark: SparkSession) -> None:
    """Keyed state with lists, values and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(row) -> tuple:
    """Place of an event in time; nulls come first, as in the batch windows."""
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or 0)


def _fields(rows, names: list[str]) -> Iterator[tuple]:
    """The named fields of each row."""
    pick = None
    for r in rows:
        if pick is None:
            pick = itemgetter(*[r.__fields__.index(n) for n in names])
        yield pick(r)


class Packing:
    """Counters up to ``most``, several of them in one 63-bit word; words are added like the counters."""

    def __init__(self, n: int, most: int):
        self.bits = most.bit_length()
        per = 63 // self.bits
        self.places = [(i // per, i % per * self.bits) for i in range(n)]
        self.words = -(-n // per)

    def pack(self, flags: list[Column]) -> list[Column]:
        """Words that hold 1 for each condition that is true."""
        words = [F.lit(0).cast("bigint") for _ in range(self.words)]
        for (w, shift), c in zip(self.places, flags):
            words[w] = words[w] + F.when(c, F.lit(1 << shift).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return words

    def unpack(self, prefix: str) -> list[Column]:
        return [F.shiftright(F.col(f"{prefix}{w}"), shift).bitwiseAND(F.lit((1 << self.bits) - 1))
                for w, shift in self.places]


class LastEvents(StatefulProcessor):
    """Sums and distinct counts over a key's last ``size`` rows, and running totals, per new row.

    Reads ``us``, ``id``, ``flag0``... (what to sum over the last rows, packed), ``steps`` (a bit per total that goes up),
    ``value0``... (what to count distinct; nulls don't count), ``note`` (text that is given back for all last
    rows, if ``noted``) and ``row``. Emits ``row`` with ``n``, ``sum0``... and ``kind0``... (packed), ``totals`` and ``notes``.
    State, read and written once a key and batch: the last ``size`` - 1 rows and the totals, forgotten when the
    watermark is ``idle_ms`` past the key's last event.
    """

    def __init__(self, size: int, n_flags: int, n_steps: int, n_values: int, noted: bool, idle_ms: int | None = None):
        self.size, self.n_steps, self.n_values, self.noted, self.idle_ms = size, n_steps, n_values, noted, idle_ms
        self.flags, self.kinds = Packing(n_flags, size), Packing(n_values, size)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state", "us array<bigint>, id array<bigint>, flags array<bigint>, values array<string>, "
            "notes array<string>, totals array<bigint>, ms bigint")

    def _load(self) -> tuple[list[tuple], list[int], int | None]:
        """The last rows, the totals and the time that the timer is set after."""
        if not self.state.exists():
            return [], [0] * self.n_steps, None
        us, ids, flags, values, notes, totals, ms = self.state.get()
        w, v = self.flags.words, self.n_values
        return [(us[i], ids[i], flags[i * w:i * w + w], values[i * v:i * v + v], notes[i]) for i in range(len(us))], list(totals), ms

    def _store(self, tail: list[tuple], totals: list[int], ms: int | None) -> None:
        self.state.update((
            [r[0] for r in tail], [r[1] for r in tail], [x for r in tail for x in r[2]], [x for r in tail for x in r[3]],
            [r[4] for r in tail], totals, ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        w, v = self.flags.words, self.n_values
        names = ["us", "id", "note", "steps", "row", *[f"flag{i}" for i in range(w)], *[f"value{i}" for i in range(v)]]
        out = Row("row", "n", *[f"sum{i}" for i in range(w)], *[f"kind{i}" for i in range(self.kinds.words)], "totals", "notes")
        tail, totals, before = self._load()
        # A key that only has an initial state comes with a row of nulls.
        new = [(r[0], r[1], r[5:5 + w], r[5 + w:], r[2], r[3], r[4]) for r in _fields(rows, names) if r[3] is not None]
        held: deque = deque()
        sums, seen = [0] * w, [Counter() for _ in range(v)]
        for row in sorted([*tail, *new], key=_in_order):
            if self._was_idle(held, row):
                held.clear()
                sums, seen, totals = [0] * w, [Counter() for _ in seen], [0] * self.n_steps
            held.append(row)
            sums = [s + x for s, x in zip(sums, row[2])]
            for kinds, value in zip(seen, row[3]):
                if value is not None:
                    kinds[value] += 1
            if len(held) > self.size:
                gone = held.popleft()
                sums = [s - x for s, x in zip(sums, gone[2])]
                for kinds, value in zip(seen, gone[3]):
                    if value is not None:
                        kinds[value] -= 1
                        if not kinds[value]:
                            del kinds[value]
            if len(row) > 5:
                if row[5]:
                    totals = [t + (row[5] >> i & 1) for i, t in enumerate(totals)]
                found = [0] * self.kinds.words
                for (at, shift), kinds in zip(self.kinds.places, seen):
                    found[at] += len(kinds) << shift
                yield out(row[6], len(held), *sums, *found, totals, [h[4] for h in held] if self.noted else None)
        if self.idle_ms is not None:
            before = self._wait(before, max((r[0] for r in held if r[0] is not None), default=0) // 1000)
        self._store(list(held)[-(self.size - 1):], totals, before)

    def _was_idle(self, held, row) -> bool:
        """Whether the actor had been silent for too long; the timer only comes after the batch's rows."""
        return bool(self.idle_ms is not None and held and held[-1][0] is not None
                    and row[0] - held[-1][0] > self.idle_ms * 1000)

    def _wait(self, before: int | None, last_ms: int) -> int:
        if before != last_ms:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last_ms + self.idle_ms)
        return last_ms

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._store([(r["us"], r["id"], r["flags"], r["values"], r["note"]) for r in initialState["tail"]],
                    list(initialState["totals"]), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _asked(keys: list[str], columns: list[str], size: int, flags: list[Column], steps: list[Column], values: list[Column],
           note: Column) -> list[Column]:
    step = F.lit(0).cast("bigint")
    for i, c in enumerate(steps):
        step = step + F.when(c, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return [*[F.col(k) for k in keys], F.col("us"), F.col("audit_id").cast("bigint").alias("id"),
            *[c.alias(f"flag{i}") for i, c in enumerate(Packing(len(flags), size).pack(flags))], step.alias("steps"),
            *[v.cast("string").alias(f"value{i}") for i, v in enumerate(values)],
            note.cast("string").alias("note"), F.struct(*columns).alias("row")]


class ActorHistory:
    """Feature rows (and token windows) of a stream of normalised events, as streams.

    ``before`` is a batch table of earlier events: the stream starts with what they leave behind. With
    ``idle_us`` (event time, needs a watermark on the stream) actors are forgotten that have been silent so long.
    """

    def __init__(self, keys: list[str] = W.GROUP, size: int = K.WINDOW_EVENTS, before: DataFrame | None = None,
                 idle_us: int | None = None):
        self.keys, self.size, self.before, self.idle_us = keys, size, before, idle_us

    def _run(self, events: DataFrame, columns: list[str], flags: dict, steps: dict, values: dict, note: Column | None
             ) -> DataFrame:
        use_engine_state(events.sparkSession)
        text = F.lit(None) if note is None else note
        parts = self.size, list(flags.values()), list(steps.values()), list(values.values()), text
        asked = _asked(self.keys, columns, *parts)
        if self.idle_us is not None:
            asked.append(F.col("ts"))
        ready = events.select(*asked)
        idle = None if self.idle_us is None else self.idle_us // 1000
        made = LastEvents(self.size, len(flags), len(steps), len(values), note is not None, idle)
        out = T.StructType([
            T.StructField("row", ready.schema["row"].dataType), T.StructField("n", T.LongType()),
            *[T.StructField(f"sum{i}", T.LongType()) for i in range(made.flags.words)],
            *[T.StructField(f"kind{i}", T.LongType()) for i in range(made.kinds.words)],
            T.StructField("totals", T.ArrayType(T.LongType())), T.StructField("notes", T.ArrayType(T.StringType()))])
        start = None if self.before is None else self._start(parts)
        return ready.groupBy(*self.keys).transformWithState(
            made, out, "Append", "None" if idle is None else "EventTime", initialState=start)

    def _start(self, parts):
        """State after the earlier events: the last rows and the totals of each key."""
        rows = self.before.select(*_asked(self.keys, ["us"], *parts))
        words = [c for c in rows.columns if c.startswith("flag")]
        values = [c for c in rows.columns if c.startswith("value")]
        last = F.struct("us", "id", F.array(*words).cast("array<bigint>").alias("flags"),
                        F.array(*values).cast("array<string>").alias("values"), "note")
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("us"), F.desc("id"))
        tail = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") < self.size).groupBy(
            *self.keys).agg(F.sort_array(F.collect_list(last)).alias("tail"))
        totals = rows.groupBy(*self.keys).agg(F.array(*[
            F.sum(F.shiftright("steps", i).bitwiseAND(F.lit(1))) for i in range(len(parts[2]))])
            .cast("array<bigint>").alias("totals"))
        return tail.join(totals, self.keys).groupBy(*self.keys)

    def features(self, events: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The events, or their columns ``keep``, with the features of ``windows.window_features``.

        Only these columns travel through the state's tasks.
        """
        columns = events.columns if keep is None else keep
        flags, values = W.counted_conditions(), W.distinct_values()
        steps = {name: make() for name, make in W.CUMULATIVE.items()}
        found = self._run(events, columns, flags, steps, values, None)
        sums, kinds = (Packing(len(x), self.size).unpack(p) for x, p in ((flags, "sum"), (values, "kind")))
        counts = {"n_events": F.col("n"), **dict(zip(flags, sums)), **dict(zip(values, kinds)),
                  **{f"cum_{c}": F.col("totals")[i] for i, c in enumerate(steps)}}
        return W.derived_features(found.select("row.*", *[v.alias(c) for c, v in counts.items()]),
                                  columns, self.size)

    def token_windows(self, events: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The events, or their columns ``keep``, with ``tokens``, their actor's last ones, padded on the left."""
        found = self._run(events, events.columns if keep is None else keep, {}, {}, {}, W.token_column())
        padding = F.array_repeat(F.lit("<PAD>"), F.lit(self.size) - F.size("notes"))
        return found.select("row.*", F.concat(padding, "notes").alias("tokens"))


class EpisodeAlerts(StatefulProcessor):
    """One alert row when an episode's fired windows reach ``k``; with ``re_alert`` one per batch from then on.

    State per episode: fired windows, highest probability, rules seen so far and the last event, over
    all batches. Reads ``prob``, ``us``, ``audit_id``, ``verb``, ``resource`` and one boolean per reason.
    """

    def __init__(self, keys: list[str], reasons: list[str], threshold: float, k: int, re_alert: bool):
        self.keys, self.reasons, self.threshold, self.k, self.re_alert = keys, reasons, threshold, k, re_alert

    def init(self, handle) -> None:
        self.state = handle.getValueState(
            "episode", "fired bigint, max_prob double, alerted boolean, reasons array<boolean>, us bigint, "
            "audit_id bigint, verb string, resource string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fired, top, alerted, seen, *last = self.state.get() if self.state.exists() else (
            0, None, False, [False] * len(self.reasons), None, None, None, None)
        for prob, *event in _fields(rows, ["prob", "us", "audit_id", "verb", "resource", *self.reasons]):
            if prob is not None:
                fired += prob >= self.threshold
                top = prob if top is None else max(top, prob)
            if self.reasons:
                seen = [a or bool(x) for a, x in zip(seen, event[4:])]
            last = max(last, event[:4], key=_in_order)
        due = fired >= self.k and (self.re_alert or not alerted)
        self.state.update((fired, top, alerted or fired >= self.k, seen, *last))
        if due:
            yield Row(**dict(zip(self.keys, key)), n_windows_fired=fired, max_prob=top,
                      reasons=[n for n, s in zip(self.reasons, seen) if s], last_verb=last[2], last_resource=last[3])

    def close(self) -> None:
        pass


def episode_alerts(scored: DataFrame, keys: list[str] = W.GROUP, threshold: float = 0.5, k: int = K.HYSTERESIS_K,
                   re_alert: bool = False, reasons: dict[str, Column] | None = None) -> DataFrame:
    """Alert rows of a stream of scored windows: keys, ``n_windows_fired``, ``max_prob``, ``severity``, ``reasons``,
    ``last_verb`` and ``last_resource``. ``reasons`` are conditions over the windows."""
    use_engine_state(scored.sparkSession)
    reasons = reasons or {}
    text = [F.col(c) if c in scored.columns else F.lit(None).cast("string").alias(c) for c in ("verb", "resource")]
    place = [F.col(c).cast("bigint") if c in scored.columns else F.lit(None).cast("bigint").alias(c)
             for c in ("us", "audit_id")]
    ready = scored.select(*keys, F.col("prob").cast("double").alias("prob"), *place, *text,
                          *[F.coalesce(c, F.lit(False)).alias(n) for n, c in reasons.items()])
    out = T.StructType([
        *[scored.schema[k_] for k_ in keys], T.StructField("n_windows_fired", T.LongType()),
        T.StructField("max_prob", T.DoubleType()), T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("last_verb", T.StringType()), T.StructField("last_resource", T.StringType())])
    alerts = ready.groupBy(*keys).transformWithState(
        EpisodeAlerts(keys, list(reasons), threshold, k, re_alert), out, "Append", "None")
    return alerts.withColumn("severity", severity_band(F.col("max_prob")))


def live_alerts(events: DataFrame, score, keys: list[str] = W.GROUP, history: ActorHistory | None = None, **kw
                ) -> DataFrame:
    """From events to alert records in one streaming query: features, ``score`` (adds ``prob``), episodes."""
    rows = score((history or ActorHistory(keys)).features(events))
    return episode_alerts(rows, keys, reasons=window_signals(), **kw)


def first_seen(events: DataFrame, column: str) -> DataFrame:
    """A row when a value comes up for the first time, over all batches; nulls count as a value."""
    return events.select(column).dropDuplicates([column])

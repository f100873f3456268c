"""Live monitoring rules and alert notifications: stateful processors with values and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tracewell.streaming.jobs import LATENESS
from tracewell.streaming.state import _fields, use_engine_state

WAIT_US = 5_000_000
INTERVAL_US = 10_000_000
REPEAT_US = 1_800_000_000


class Increase(StatefulProcessor):
    """Difference of a series' last value to that of its window before; a drop counts as a restart from zero."""

    def __init__(self, labels: list[str]):
        self.labels = labels

    def init(self, handle) -> None:
        self.before = handle.getValueState("before", "v bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.before.get()[0] if self.before.exists() else None
        for win_us, v in sorted((r["win_us"], r["v"]) for r in rows):
            step = v if before is None or v < before else v - before
            before = v
            yield Row(**dict(zip(self.labels, key)), win_us=win_us, increase=step)
        if before is not None:
            self.before.update((before,))

    def close(self) -> None:
        pass


class Change(StatefulProcessor):
    """Difference of a sum to that of the window right before it, 0 where that window has none."""

    def __init__(self, width_us: int):
        self.width_us = width_us

    def init(self, handle) -> None:
        self.before = handle.getValueState("before", "win_us bigint, now bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, was = tuple(self.before.get()) if self.before.exists() else (None, 0)
        for win_us, now in sorted((r["win_us"], r["now"]) for r in rows):
            yield Row(win_us=win_us, now=now, change=now - (was if at == win_us - self.width_us else 0))
            at, was = win_us, now
        if at is not None:
            self.before.update((at, was))

    def close(self) -> None:
        pass


def _last_values(samples: DataFrame, labels: list[str], minutes: int, lateness: str) -> DataFrame:
    """Last value per series and window, given out when the watermark passes the window's end."""
    return (samples.withWatermark("ts", lateness)
            .groupBy(F.window("ts", f"{minutes} minutes").alias("w"), *labels)
            .agg(F.max_by("value", F.struct("us", "seq")).cast("bigint").alias("v")))


def live_increase(samples: DataFrame, minutes: int = 1, labels: list[str] = ["metric", "label"],
                  lateness: str = LATENESS) -> DataFrame:
    """``monitor.increase`` of a stream of samples (``ts``, ``us``, ``seq``, labels, ``value``)."""
    use_engine_state(samples.sparkSession)
    last = _last_values(samples, labels, minutes, lateness).select(
        *labels, F.unix_micros("w.start").alias("win_us"), "v")
    out = T.StructType([*[last.schema[c] for c in labels], T.StructField("win_us", T.LongType()),
                        T.StructField("increase", T.LongType())])
    return last.groupBy(*labels).transformWithState(Increase(labels), out, "Append", "None")


def live_offset(samples: DataFrame, minutes: int = 1, labels: list[str] = ["metric", "label"],
                lateness: str = LATENESS) -> DataFrame:
    """``monitor.offset_rule`` of a stream, before its filter: per window the sum of all series and its change.

    The sums are made by the engine, so one row per window reaches the key that compares them.
    """
    use_engine_state(samples.sparkSession)
    width = f"{minutes} minutes"
    sums = (_last_values(samples, labels, minutes, lateness)
            .groupBy(F.window(F.window_time("w"), width).alias("w")).agg(F.sum("v").alias("now"))
            .select(F.lit("").alias("all"), F.unix_micros("w.start").alias("win_us"), "now"))
    return sums.groupBy("all").transformWithState(
        Change(minutes * 60_000_000), "win_us bigint, now bigint, change bigint", "Append", "None")


class Notify(StatefulProcessor):
    """Notifications of one alert name.

    The first firing waits ``wait_us`` for others. After a notification an instance that was not in it is
    notified ``interval_us`` later at the earliest, one that goes on firing after ``repeat_us``. When nothing
    has fired for ``repeat_us`` the group is over and the next firing is a first one. Times are event times: a
    notification that is due before the next firing is given out with it, one that waits alone by a timer.
    """

    def __init__(self, wait_us: int, interval_us: int, repeat_us: int):
        self.wait_us, self.interval_us, self.repeat_us = wait_us, interval_us, repeat_us

    def init(self, handle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "due bigint, last bigint, fired bigint, pending bigint, timer bigint")
        self.known = handle.getMapState("known", "instance string", "us bigint")

    def _notify(self, name: str, g: dict) -> Row:
        row = Row(alertname=name, notify_us=g["due"], firings=g["pending"], first=g["last"] is None)
        g |= {"last": g["due"], "due": None, "pending": 0}
        return row

    def _store(self, g: dict) -> None:
        timer = None if g["due"] is None else -(-g["due"] // 1000)
        if timer != g["timer"]:
            if g["timer"] is not None:
                self.handle.deleteTimer(g["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            g["timer"] = timer
        self.group.update(tuple(g.values()))

    def _load(self) -> dict:
        values = tuple(self.group.get()) if self.group.exists() else (None, None, None, 0, None)
        return dict(zip(("due", "last", "fired", "pending", "timer"), values))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        g = self._load()
        same: dict[str, str] = {}  # one string per instance, however often it fires
        firings = sorted((us, same.setdefault(x or "", x or "")) for us, x in _fields(rows, ["us", "instance"]))
        # The state is asked and told once per instance, not per firing.
        known: dict[str, int] = {}
        cleared = False
        for us, instance in firings:
            if g["due"] is not None and g["due"] <= us:
                yield self._notify(key[0], g)
            if g["due"] is None and g["last"] is not None and us - g["fired"] > self.repeat_us:
                known.clear()
                cleared = True
                g["last"] = None
            fresh = instance not in known and (cleared or not self.known.containsKey((instance,)))
            known[instance] = us
            g["pending"] += 1
            g["fired"] = us if g["fired"] is None else max(us, g["fired"])
            if g["last"] is None:
                g["due"] = us + self.wait_us if g["due"] is None else g["due"]
            else:
                then = max(us, g["last"] + (self.interval_us if fresh else self.repeat_us))
                g["due"] = then if g["due"] is None else min(then, g["due"])
        if cleared:
            self.known.clear()
        for instance, us in known.items():
            self.known.updateValue((instance,), (us,))
        self._store(g)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        g = self._load()
        g["timer"] = None  # this one
        if g["due"] is not None and g["due"] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            yield self._notify(key[0], g)
        self._store(g)

    def close(self) -> None:
        pass


def notifications(firings: DataFrame, wait_us: int = WAIT_US, interval_us: int = INTERVAL_US, repeat_us: int = REPEAT_US,
                  lateness: str = LATENESS) -> DataFrame:
    """``alertname``, ``notify_us``, ``firings`` and ``first`` of a stream of firings (``ts``, ``us``, ``alertname``,
    ``instance``)."""
    use_engine_state(firings.sparkSession)
    ready = firings.withWatermark("ts", lateness).select("ts", "us", "alertname", F.col("instance").cast("string").alias("instance"))
    return ready.groupBy("alertname").transformWithState(
        Notify(wait_us, interval_us, repeat_us), "alertname string, notify_us bigint, firings bigint, first boolean",
        "Append", "EventTime")

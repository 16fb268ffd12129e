"""Live detection over records that arrive out of order: Structured Streaming with a reorder buffer, event-time timers and expiry.

Records of a key (a video, a run) wait in keyed state until the watermark has passed them, so that those which come late, but within the
delay, still count in their place; then they go through a state machine in order. A timer releases what waits when no
more records of the key come, and after ``idle`` without records the key is finished: the machine tells what it still holds, and its state
is dropped. The state of a key is the records within the delay and what the machine remembers.
Records without a key or number only move the watermark; those that come later than the delay are left out, by Spark. Sinks write each micro-batch under its number, so that a batch that is
run again after a failure replaces what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: the state store that keyed state with timers needs
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Content:
    """Cuts where the value changes by ``threshold``; closer than ``length``, they merge into one or the later are left out."""

    def __init__(self, threshold: float, length: int, merges: bool = True):
        self.threshold, self.length, self.merges = threshold, length, merges

    def step(self, s: dict, frame: int, value: float) -> list[int]:
        above = abs(value - s.get("value", value)) >= self.threshold
        s["value"] = value
        if self.length <= 0:
            return [frame] if above else []
        before = s.setdefault("last", frame)
        far = frame - before >= self.length
        if not self.merges:
            if above and far:
                s["last"] = frame
                return [frame]
            return []
        if above:
            s["last"] = frame
        if s.get("since") is not None:
            if far and not above and s["last"] - s["since"] >= self.length:
                s["since"] = None
                return [s["last"]]
        elif above and far:
            s["enabled"] = True
            return [frame]
        elif above and s.get("enabled"):
            s["since"] = frame
        return []

    def end(self, s: dict, frame: int) -> list[int]:
        return []


class Adaptive:
    """Cuts where the change is ``threshold`` times that of the ``width`` frames on either side, and ``min_content`` at least."""

    def __init__(self, threshold: float = 3.0, width: int = 2, min_content: float = 15.0, length: int = 15):
        self.threshold, self.width, self.min_content, self.length = threshold, width, min_content, length

    def step(self, s: dict, frame: int, value: float) -> list[int]:
        recent = s.setdefault("recent", [])
        recent.append([frame, abs(value - s.get("value", value))])
        s["value"] = value
        last = s.setdefault("last", frame)
        if len(recent) <= 2 * self.width:
            return []
        at, score = recent[self.width]
        mean = (sum(r[1] for r in recent) - score) / (2.0 * self.width)
        recent.pop(0)
        ratio = min(score / mean, 255.0) if abs(mean) >= 0.00001 else 255.0 if score >= self.min_content else 0.0
        if ratio < self.threshold or score < self.min_content or frame - last < self.length:
            return []
        s["last"] = at
        return [at]

    def end(self, s: dict, frame: int) -> list[int]:
        return []


class Fades:
    """Cuts between a fade below ``threshold`` and the next above it, by ``bias``; with ``final_scene`` also where a video ends in the dark."""

    def __init__(self, threshold: float, bias: float = 0.0, length: int = 15, ceiling: bool = False, final_scene: bool = False):
        self.threshold, self.bias, self.length, self.ceiling, self.final_scene = threshold, bias, length, ceiling, final_scene

    def step(self, s: dict, frame: int, value: float) -> list[int]:
        low = value < self.threshold
        if "dark" not in s:
            s["dark"], s["out"], s["last"] = low, 0, frame
            return []
        dark, before = low != self.ceiling, s["dark"]
        s["dark"] = dark
        if dark and not before:
            s["out"] = frame
        if dark or not before or frame - s["last"] < self.length:
            return []
        s["last"] = frame
        return [(frame + s["out"] + int(self.bias * (frame - s["out"]))) // 2]

    def end(self, s: dict, frame: int) -> list[int]:
        return [s["out"]] if self.final_scene and s.get("dark") and frame - s["last"] >= self.length else []


class Scenes:
    """(video, rule, scene, start_frame, end_frame): scenes of each named rule, told when the cut that ends them is known, the last at the end."""

    output = "video string, rule string, scene long, start_frame long, end_frame long"
    payload = "value double"

    def __init__(self, rules: dict[str, Content | Adaptive | Fades]):
        self.rules = rules

    def _ended(self, s: dict, name: str, cut: int) -> tuple:
        start, s["scene"], s["start"] = s["start"], s["scene"] + 1, cut
        return name, s["scene"], start, cut

    def step(self, state: dict, at: int, values: tuple) -> Iterator[tuple]:
        for name, rule in self.rules.items():
            s = state.setdefault(name, {"scene": 0, "start": at, "rule": {}})
            for cut in rule.step(s["rule"], at, values[0]):
                yield self._ended(s, name, cut)

    def end(self, state: dict, at: int) -> Iterator[tuple]:
        for name, rule in self.rules.items():
            s = state[name]
            for cut in rule.end(s["rule"], at):
                yield self._ended(s, name, cut)
            yield self._ended(s, name, at + 1)


class Buckets:
    """(run, kind, stream, number, n, bytes): buckets of ``size`` records over all streams of a run, with counts and bytes of each stream when they are
    full or the run ends; and every ``every``-th record of a stream, which analysers are to see."""

    output = "run string, kind string, stream string, number long, n long, bytes long"
    payload = "stream string, bytes long"

    def __init__(self, size: int, every: int):
        self.size, self.every = size, every

    def _full(self, state: dict) -> Iterator[tuple]:
        for stream, (n, total) in sorted(state["open"].items()):
            yield "bucket", stream, state["bucket"], n, total
        state["bucket"], state["open"] = state["bucket"] + 1, {}

    def step(self, state: dict, at: int, values: tuple) -> Iterator[tuple]:
        stream, size = values
        if not state:
            state.update(bucket=0, open={}, seen={})
        seen = state["seen"].get(stream, 0)
        if seen % self.every == 0:
            yield "sample", stream, seen, 1, size
        state["seen"][stream] = seen + 1
        n, total = state["open"].get(stream, (0, 0))
        state["open"][stream] = (n + 1, total + size)
        if sum(n for n, _ in state["open"].values()) == self.size:
            yield from self._full(state)

    def end(self, state: dict, at: int) -> Iterator[tuple]:
        yield from self._full(state)


class InOrder(StatefulProcessor):
    """Feeds a key's records to ``machine`` in the order of their number, once the watermark has passed them."""

    def __init__(self, machine, names: list[str], idle_ms: int):
        self.machine, self.names, self.idle_ms = machine, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a list, which goes to the state store and back in batches and not record by record
        self.waiting = handle.getListState("waiting", f"at long, ms long, {self.machine.payload}")
        self.memory = handle.getValueState("memory", "state string, at long, ms long, timer long")

    def _held(self) -> dict[int, tuple]:
        return {number: values for number, *values in self.waiting.get()} if self.waiting.exists() else {}

    def _released(self, key: tuple, mark: int, records: dict[int, tuple]) -> pd.DataFrame:
        state, at, latest, timer = self.memory.get() if self.memory.exists() else ("{}", -1, -1, -1)
        state, out, left = json.loads(state), [], []
        for number in sorted(records):
            ms, *values = records[number]
            latest = max(latest, ms)
            if ms > mark:
                left.append((number, ms, *values))
                continue
            if number > at:
                out += self.machine.step(state, number, tuple(values))
                at = number
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if not left and latest >= 0 and mark >= latest + self.idle_ms:
            out += self.machine.end(state, at) if state else []
            self.memory.clear()
            self.waiting.clear()
        else:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            timer = min(ms for _, ms, *_ in left) if left else latest + self.idle_ms
            self.handle.registerTimer(timer)
            self.memory.update((json.dumps(state), at, latest, timer))
        return pd.DataFrame([(key[0], *o) for o in out], columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] is None:
            return
        records = self._held()
        for part in rows:
            for row in part.itertuples(index=False):
                _, at, ms, *values = row[:-1]  # the last is the event time itself
                if pd.isna(at) or pd.isna(ms):
                    continue
                records[int(at)] = (int(ms), *(v.item() if hasattr(v, "item") else v for v in values))
        yield self._released(key, timerValues.getCurrentWatermarkInMs(), records)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.memory.exists():
            yield self._released(key, timerValues.getCurrentWatermarkInMs(), self._held())

    def close(self) -> None:
        pass


def in_order(records: DataFrame, key: str, at: str, machine, delay: str, idle: str) -> DataFrame:
    """The machine's output over a stream ``records`` with a timestamp ``ts``, by key in order of ``at``, a number that grows with ``ts``."""
    fields = [f.strip().split()[0] for f in machine.payload.split(",")]
    rows = records.withWatermark("ts", delay)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), *fields, "ts")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = [f.strip().split()[0] for f in machine.output.split(",")]
    return rows.groupBy("key").transformWithStateInPandas(InOrder(machine, names, idle_ms), machine.output, "Append", "eventTime")


def live_scenes(frames: DataFrame, rules: dict[str, Content | Adaptive | Fades], delay: str, idle: str = "1 hour") -> DataFrame:
    """Scenes by rule of a stream ``frames(video, frame, ts, value)``; see ``Scenes``."""
    return in_order(frames, "video", "frame", Scenes(rules), delay, idle)


def live_buckets(records: DataFrame, size: int, every: int, delay: str, idle: str = "1 hour") -> DataFrame:
    """Buckets and samples of a stream ``records(run, at, ts, stream, bytes)``; see ``Buckets``."""
    return in_order(records, "run", "at", Buckets(size, every), delay, idle)


def run_available(stream: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Take what the source holds, in micro-batches, and give all that was written to ``out`` so far.

    ``each`` is called with a batch and its number after it was written, again if the batch is run again.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        if each is not None:
            each(batch.sparkSession.read.schema(batch.schema).parquet(path), number)

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        query = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")

"""Jobs and their stages from events: the same states from a stream in any micro-batches and from a whole table.

An event is (job_id, stage, seq, at, event), event one of start, finish, skip, fail. A stage is pending until its first event; start makes it active,
finish, skip and fail end it; an active stage ends by finish or fail; what makes no sense changes nothing, and nothing follows an end.
A job that is silent for longer than its limit has its active stages ended as errors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# What ends a stage, and as what.
ENDS = {"finish": "done", "skip": "skipped", "fail": "error"}
KNOWN = ("start", *ENDS)
SILENT = "The job stopped reporting."

STAGES = "job_id long, stage string, status string, seconds double, detail string"


def stages(events: DataFrame, silence: float | None = None, now: Column | None = None, digits: int = 1) -> DataFrame:
    """STAGES of a table of events, seconds with so many digits. With `silence` (seconds), stages active in jobs whose last event is further back from `now` are errors.

    A stage's state depends on its first event, and on its first finish or fail where that was a start, so that two minima tell it: a job of any
    number of events is combined before it is shuffled. Events of equal seq count in the order of at and event. Events with a null field are left out.
    """
    good = events.where(F.col("event").isin(*KNOWN)).dropna(subset=["job_id", "stage", "seq", "at"]).withColumn("at", F.col("at").cast("timestamp"))
    event = F.struct("seq", "at", "event")
    rows = good.groupBy("job_id", "stage").agg(F.min(event).alias("a"), F.min(F.when(F.col("event").isin("finish", "fail"), event)).alias("b"), F.max("at").alias("_last"))
    ended = F.create_map(*(F.lit(x) for pair in ENDS.items() for x in pair))
    started = F.col("a.event") == "start"
    status = F.when(~started, ended[F.col("a.event")]).when(F.col("b").isNull(), "active").otherwise(ended[F.col("b.event")])
    rows = rows.select("job_id", "stage", status.alias("status"), F.when(started & F.col("b").isNotNull(), F.round((F.unix_micros("b.at") - F.unix_micros("a.at")) / 1e6, digits)).alias("seconds"), "_last")
    detail = F.lit(None).cast("string")
    if silence is not None:
        last = rows.groupBy("job_id").agg(F.max("_last").alias("_job_last"))
        rows = rows.join(last, "job_id").withColumn("_lost", (F.col("status") == "active") & (now.cast("double") - F.col("_job_last").cast("double") > silence))
        rows, detail = rows.withColumn("status", F.when(F.col("_lost"), "error").otherwise(F.col("status"))), F.when(F.col("_lost"), SILENT)
    return rows.select("job_id", "stage", "status", "seconds", detail.alias("detail"))


class _Jobs(StatefulProcessor):
    """A job's stages so far, its events that the watermark has not passed, in which order they may still come, and a timer for both."""

    def __init__(self, silence: float | None) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.stages = handle.getListState("stages", "stage string, status string, since long, seconds double, detail string")
        self.waiting = handle.getListState("waiting", "stage string, seq long, us long, event string")

    @staticmethod
    def _folded(known: dict[str, tuple], events: list[tuple]) -> dict[str, tuple]:
        """stage -> (status, since, seconds, detail) after more events (stage, seq, microseconds, event), in order."""
        out = dict(known)
        for stage, _, us, event in sorted(events, key=lambda e: (e[1], e[2], e[3])):
            status, since, *_ = out.get(stage, ("pending", None, None, None))
            if status == "pending" and event == "start":
                out[stage] = "active", us, None, None
            elif status == "pending":
                out[stage] = ENDS[event], None, None, None
            elif status == "active" and event in ("finish", "fail"):
                out[stage] = ENDS[event], since, round((us - since) / 1e6, 1), None
        return out

    def _known(self) -> dict[str, tuple]:
        return {r[0]: tuple(r[1:]) for r in self.stages.get()} if self.stages.exists() else {}

    def _rows(self, key: tuple, now: dict[str, tuple]) -> Iterator[Row]:
        for stage, (status, _, seconds, detail) in sorted(now.items()):
            yield Row(job_id=key[0], stage=stage, status=status, seconds=seconds, detail=detail)

    def _settle(self, passed: int) -> tuple[dict[str, tuple], list[tuple]]:
        """The stages after all events that the watermark (milliseconds) has passed, which stop waiting, and the others."""
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = [e for e in waiting if e[2] <= passed * 1000]
        known = self._folded(self._known(), ready)
        if ready:
            left = [e for e in waiting if e[2] > passed * 1000]
            self.stages.put([(s, *v) for s, v in known.items()])
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            waiting = left
        return known, waiting

    def _remind(self, waiting: list[tuple], passed: int) -> None:
        """One timer: at the next event that waits, else when the job has been silent for too long."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if waiting:
            self.handle.registerTimer(max(passed + 1, -(-min(e[2] for e in waiting) // 1000)))
        elif self.silence is not None and self.last.exists():
            self.handle.registerTimer(max(passed + 1, int(self.last.get()[0] / 1000 + self.silence * 1000) + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["stage"], r["seq"], r["us"], r["event"]) for r in rows]
        self.waiting.appendList(new)
        ahead = max(e[2] for e in new)
        if not self.last.exists() or self.last.get()[0] < ahead:
            self.last.update((ahead,))
        passed = timerValues.getCurrentWatermarkInMs()
        known, waiting = self._settle(passed)
        self._remind(waiting, passed)
        yield from self._rows(key, self._folded(known, waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        known, waiting = self._settle(passed)
        if not waiting and self.silence is not None and self.last.exists() and passed * 1000 - self.last.get()[0] > self.silence * 1e6:
            lost = {s: ("error", v[1], v[2], SILENT) if v[0] == "active" else v for s, v in known.items()}
            if lost != known:
                self.stages.put([(s, *v) for s, v in lost.items()])
                yield from self._rows(key, lost)
            return
        self._remind(waiting, passed)

    def close(self) -> None:
        pass


def stage_updates(events: DataFrame, lateness: str, silence: float | None = None) -> DataFrame:
    """A stream of STAGES rows, all of a job's stages whenever it has new events or has been silent for too long; the last row of a stage is its state.

    Events (job_id, stage, seq, at, event; at a timestamp) may come in any order within `lateness` of the latest one: those that the watermark hasn't
    passed wait in the state and count provisionally. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    good = events.where(F.col("event").isin(*KNOWN)).dropna(subset=["job_id", "stage", "seq", "at"])
    rows = good.select(F.col("job_id").cast("long").alias("job_id"), "stage", F.col("seq").cast("long").alias("seq"), "at", F.unix_micros("at").alias("us"), "event").withWatermark("at", lateness)
    return rows.groupBy("job_id").transformWithState(_Jobs(silence), STAGES, "Update", "EventTime")

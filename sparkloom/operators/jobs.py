"""The job event log: latest states, tails, retries and failure rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.sources import files

ACTIVE = ("queued", "running", "pausing", "paused", "resuming")


def created(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New jobs in the queue, and the first event of each, to be appended to the two tables."""
    queued = {"status": F.lit("queued"), "stage": F.lit("queued"), "percent": F.lit(0.0)}
    rows = jobs.withColumns(queued | {"stats": F.lit("{}")})
    return rows, jobs.select("job_id").withColumns(queued | {"message": F.lit("Job created")})


def latest_state(events: DataFrame) -> DataFrame:
    """Per job: its last event's status, percent and message (null if that has none), and the number of events.

    With a column ``stats``, the last that was given: events without keep what was there.
    """
    stats = [F.max_by("stats", F.when(F.col("stats").isNotNull(), F.col("event_id"))).alias("stats")] if "stats" in events.columns else []
    last = events.groupBy("job_id").agg(F.max_by(F.struct("status", "percent", "message"), "event_id").alias("last"), F.max("event_id").alias("event_id"), F.count("*").alias("n_events"), *stats)
    return last.select("job_id", "event_id", "last.status", "last.percent", "last.message", "n_events", *(["stats"] if stats else []))


def job_list(events: DataFrame, limit: int = 20) -> DataFrame:
    """The jobs made last, newest first: ``job_id, first_event, status``; a top-k."""
    first = events.groupBy("job_id").agg(F.min("event_id").alias("first_event"), F.max_by("status", "event_id").alias("status"))
    return first.orderBy(F.desc("first_event")).limit(limit)


def active_job(events: DataFrame) -> DataFrame:
    """The job in an active state whose first event is the oldest."""
    first = events.groupBy("job_id").agg(F.min("event_id").alias("first_event"), F.max_by("status", "event_id").alias("status"))
    return first.where(F.col("status").isin(*ACTIVE)).orderBy("first_event").limit(1)


def tail(events: DataFrame, after: int) -> DataFrame:
    return events.where(F.col("event_id") > after)


def backoff(attempts: DataFrame, first: float = 0.25, factor: float = 2.0, most: float = 30.0) -> DataFrame:
    """``attempt, wait_s``: seconds to wait after each attempt; a ``retry_after`` that the server named goes before."""
    own = F.least(F.lit(first) * F.pow(F.lit(factor), F.col("attempt") - 1), F.lit(most))
    return attempts.select("attempt", F.coalesce(F.col("retry_after").cast("double"), own).alias("wait_s") if "retry_after" in attempts.columns else own.alias("wait_s"))


def structured_calls(replies: DataFrame, attempts: int = 6, first: float = 0.25, factor: float = 2.0, most: float = 30.0) -> DataFrame:
    """How each request ends, from the replies it would get: ``name, outcome, calls, waited_s, strict``.

    ``replies(name, attempt, error_class, message, retry_after)``, in order. A
    retryable or malformed reply is asked again, at most ``attempts`` times in
    all; a permanent one ends it, but for a first one about the response
    format, after which the request goes on without the strict schema.
    """
    per = replies.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("attempt", "error_class", F.lower(F.coalesce("message", F.lit(""))).alias("message"), F.col("retry_after").cast("double").alias("retry_after")))).alias("r"))
    start = F.struct(F.lit("open").alias("outcome"), F.lit(0).alias("calls"), F.lit(0.0).alias("waited"), F.lit(True).alias("strict"))

    def step(s: Column, r: Column) -> Column:
        going = (s["outcome"] == "open") & (s["calls"] < attempts)
        again, calls = r["error_class"].isin("retryable", "malformed"), s["calls"] + 1
        format_ = (r["error_class"] == "permanent") & s["strict"] & r["message"].rlike("response_format|strict|schema")
        outcome = F.when(r["error_class"] == "ok", "ok").when(format_ & (calls < attempts), "open").when(again & (calls < attempts), "open").otherwise(F.when(again, "exhausted").otherwise("permanent"))
        wait = F.coalesce(r["retry_after"], F.least(F.lit(first) * F.pow(F.lit(factor), s["calls"].cast("double")), F.lit(most)))
        new = F.struct(outcome.alias("outcome"), calls.alias("calls"), F.when(again & (calls < attempts), s["waited"] + wait).otherwise(s["waited"]).alias("waited"), (s["strict"] & ~format_).alias("strict"))
        return F.when(going, new).otherwise(s)

    done = per.select("name", F.aggregate("r", start, step).alias("s"))
    return done.select("name", "s.outcome", F.col("s.calls").cast("long").alias("calls"), F.col("s.waited").alias("waited_s"), "s.strict")


# Fixed values.
MILESTONES = {"scan_folder": 0.02, "ingest": 0.18, "split": 0.28, "generate_train": 0.62, "judge_train": 0.70, "generate_eval": 0.86, "judge_eval": 0.88, "judge": 0.90, "export": 0.95, "done": 1.0}
BATCHED = {"generate_train": (0.32, 0.62), "generate_eval": (0.74, 0.86)}


def milestone(stage: Column, batch: Column, batches: Column) -> Column:
    """How much of a job is done at a stage; within a generation, in proportion to its batches."""
    at = F.lit(None).cast("double")
    for name, share in MILESTONES.items():
        own = F.lit(share)
        if name in BATCHED:
            low, high = BATCHED[name]
            own = F.when(batches > 0, low + (F.lit(high) - low) * batch / batches).otherwise(own)
        at = F.when(stage == name, own).otherwise(at)
    return at


def progress(batches: DataFrame, *by: str) -> DataFrame:
    """``split, batch, total_batches, pages_processed, eta_seconds``: after each batch of ``batches(split, batch, pages, seconds)``, in order.

    Batches are counted by ``split``, or by the columns named, such as a job and its split.

    The time to come is the mean of the batches so far for each that is left.
    """
    by = by or ("split",)
    so_far = Window.partitionBy(*by).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    total = F.count("*").over(Window.partitionBy(*by))
    done = F.count("*").over(so_far)
    return batches.select(*by, "batch", total.alias("total_batches"), F.sum("pages").over(so_far).alias("pages_processed"), F.bround(F.sum("seconds").over(so_far) / done * (total - done), 2).alias("eta_seconds"))


def failure_rate(events: DataFrame, window: int = 20, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """Per event: the share of failures among a job's last ``window`` outcomes, and whether it would open the breaker."""
    outcome = events.where(F.col("status").isin("completed", "failed")).withColumn("failed", (F.col("status") == "failed").cast("int"))
    recent = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(-(window - 1), 0)
    rate = F.bround(F.avg("failed").over(recent), 3)
    return outcome.select("event_id", "job_id", rate.alias("failure_rate"), ((F.count("*").over(recent) >= least) & (F.avg("failed").over(recent) >= threshold)).alias("tripped"))


def error_class(status: Column, message: Column) -> Column:
    """``ok``, ``retryable``, ``permanent`` or, for a reply that is no JSON, ``malformed`` (asked again as well)."""
    return (
        F.when(status.isin(401, 403), "permanent").when(status == 400, "permanent").when(status.isNull() | (status == 408) | (status == 429) | (status >= 300), "retryable")
        .when(F.try_parse_json(message).isNull(), "malformed").otherwise("ok")
    )


class _Breaker:
    """One breaker's state, and what a block of its calls does to it.

    What happens next depends on where the outcomes counted begin, or when the
    breaker opened, so a block is gone through by phases, not by calls: a closed
    phase ends at its first call that trips the breaker, found in counts of
    failures over sliding windows, and an open one at the first call late enough.
    """

    def __init__(self, window: int, threshold: float, least: int, cooldown: float, successes: int):
        self.window, self.threshold, self.least, self.cooldown, self.successes = window, threshold, least, cooldown, successes
        self.state, self.recent, self.opened, self.good = "closed", np.zeros(0, bool), 0.0, 0

    def run(self, at: np.ndarray, failed: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """States after each call, as runs, and whether each call was refused."""
        n, states, refused = len(at), [], np.zeros(len(at), bool)
        i = 0
        while i < n:
            if self.state == "open":
                j = _first(at, i, self.opened + self.cooldown)
                refused[i:j] = True
                states.append(np.full(j - i, "open", object))
                if j < n:
                    self.state, self.good = "half_open", 0
                i = j
            elif self.state == "half_open":
                self.recent = np.append(self.recent, failed[i])[-self.window :]
                self.good += not failed[i]
                if failed[i]:
                    self.state, self.opened = "open", float(at[i])
                elif self.good >= self.successes:
                    self.state, self.recent = "closed", np.zeros(0, bool)
                states.append(np.full(1, self.state, object))
                i += 1
            else:
                i = self._closed(at, failed, i, states)
        return states, refused

    def _closed(self, at: np.ndarray, failed: np.ndarray, i: int, states: list[np.ndarray]) -> int:
        size = self.window
        while i < len(failed):
            # a stretch of calls after the outcomes so far; stretches grow while nothing happens
            own = np.concatenate([self.recent, failed[i : i + size]])
            k = len(self.recent)
            sums = np.concatenate([[0], np.cumsum(own)])
            ends = np.arange(k, len(own)) + 1
            begin = np.maximum(ends - self.window, 0)
            counts = ends - begin
            trips = own[k:] & (counts >= self.least) & ((sums[ends] - sums[begin]) / counts >= self.threshold)
            j = int(np.argmax(trips)) if trips.any() else len(trips)
            done = min(j + 1, len(trips))
            self.recent = own[: k + done][-self.window :]
            states.append(np.full(j, "closed", object))
            if j < len(trips):
                self.state, self.opened = "open", float(at[i + j])
                states.append(np.full(1, "open", object))
                return i + done
            i, size = i + done, min(2 * size, 1 << 16)
        return i


def _first(at: np.ndarray, i: int, least: float) -> int:
    """The first call from ``i`` on that is not before ``least``; calls need not be in the order of time."""
    size = 64
    while i < len(at):
        late = at[i : i + size] >= least
        if late.any():
            return i + int(np.argmax(late))
        i, size = i + size, min(2 * size, 1 << 16)
    return len(at)


def breaker_states(calls: DataFrame, window: int = 20, threshold: float = 0.5, least: int = 5, cooldown: float = 30.0, successes: int = 2) -> DataFrame:
    """``name, seq, state, refused``: each call's effect on its breaker, for ``calls(name, seq, at seconds, failed)``.

    A breaker's calls are read in order, sorted by Spark; they stream through in
    batches, gone through by phases in arrays, and leave only ``window``
    outcomes in memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, breaker = None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            at, failed = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            states, refused = [np.zeros(0, object)], [np.zeros(0, bool)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if breaker is None or names[a] != name:
                    name, breaker = names[a], _Breaker(window, threshold, least, cooldown, successes)
                now, off = breaker.run(at[a:b], failed[a:b])
                states += now
                refused.append(off)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(states), pa.string()), pa.array(np.concatenate(refused))], names=["name", "seq", "state", "refused"])

    ordered = calls.select("name", "seq", F.col("at").cast("double").alias("at"), F.col("failed").cast("boolean").alias("failed")).repartition("name").sortWithinPartitions("name", "seq")
    return ordered.mapInArrow(run, "name string, seq long, state string, refused boolean")


# Fixed values.
PHASES = ("ingest", "split", "generate_train", "judge_train", "generate_eval", "judge_eval", "export", "report")


def first_phase(name: str | None, only_eval: bool = False) -> str | None:
    """A phase by its name; ``generate`` and ``judge`` stand for that of train, or of eval."""
    name = f"{name}_{'eval' if only_eval else 'train'}" if name in ("generate", "judge") else name
    if name is not None and name not in PHASES:
        raise ValueError(f"unknown phase: {name}")
    return name


def save_phase(spark: SparkSession, folder: str, phase: str, outputs: Sequence[str] = (), stats: dict | None = None) -> None:
    """Marks a phase of the run in ``folder`` as done: a small JSON file with what it wrote."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase: {phase}")
    said = {"phase": phase, "completed_at": datetime.now(UTC).isoformat(), "output_files": list(outputs), "stats": stats or {}}
    files.write_json(spark, said, f"{folder}/checkpoints/{phase}.json")


def completed_phases(spark: SparkSession, folder: str) -> list[str]:
    """The phases done, in their order; some between may be missing."""
    return [p for p in PHASES if files.read_json(spark, f"{folder}/checkpoints/{p}.json").get("phase") == p]


def phase_plan(runs: DataFrame) -> DataFrame:
    """``run_id, phase, ord, runs`` for ``runs(run_id, completed array, resume, from_phase)``: from the phase named on, or what a resumed run has not done."""
    names = F.array(*map(F.lit, PHASES))
    rows = runs.select("*", F.posexplode(names).alias("ord", "phase"))
    start = F.array_position(names, F.col("from_phase")) - 1
    todo = F.when(F.col("from_phase").isNotNull(), F.col("ord") >= start).otherwise(~(F.col("resume") & F.array_contains("completed", F.col("phase"))))
    return rows.select("run_id", "phase", F.col("ord").cast("long").alias("ord"), todo.alias("runs"))

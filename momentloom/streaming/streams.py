"""Streaming forms of the batch jobs: same rules, incremental state."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from momentloom.operators.product import STALE_MINUTES, billable, credit_rows, decide, refunds_for, stage_progress
from momentloom.operators.stored import scratch
from momentloom.sources.tables import parse_agent_events
from momentloom.streaming.tail import tail_lines

#: State of a job that was reported as stale; no status of a job.
SWEPT = "swept"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# A stateful operator starts workers of its own, which do not see files added to the session: processors and the
# functions that they call go there by value.
for _name in (__name__, decide.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])


def stream_agent_events(spark: SparkSession, path: str) -> DataFrame:
    """Tail JSONL logs below ``path``, one directory per job; unreadable lines drop out.

    Files are read once, so a job's log must come as segments that are complete when they appear (written elsewhere
    and moved in, or rolled); lines appended to a file already read are not seen.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).text(path)
    return parse_agent_events(lines.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1).alias("job_id"), "value"))


def tail_agent_events(spark: SparkSession, path: str) -> DataFrame:
    """The same of logs that grow: what is appended to a file is read on, a last line without its line feed waits."""
    return parse_agent_events(tail_lines(spark, path))


def stream_progress(events: DataFrame) -> DataFrame:
    """Furthest stage per job; a maximum never moves back (update or complete mode)."""
    return stage_progress(events)


def stream_first_agents(events: DataFrame) -> DataFrame:
    """First sighting of each agent in each job, once for ever: the state is one row per pair and never expires."""
    return events.select("job_id", "agent").dropDuplicates(["job_id", "agent"])


def stream_rates(words: DataFrame, hop: str = "1 second", delay: str = "1 minute") -> DataFrame:
    """Words per tumbling bucket from ``video_id, ts``."""
    return words.withWatermark("ts", delay).groupBy("video_id", F.window("ts", hop).alias("w")).agg(F.count("*").alias("n")).select(
        "video_id", F.col("w.start").alias("start"), "n")


def stream_activity_windows(series: DataFrame, hop: str, frame: str, delay: str = "1 minute") -> DataFrame:
    """Root mean square over overlapping frames from ``video_id, ts, x``."""
    return series.withWatermark("ts", delay).groupBy("video_id", F.window("ts", frame, hop).alias("w")).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("v"), F.count("*").alias("n")).select("video_id", F.col("w.start").alias("start"), "v", "n")


class FirstOfEvent(StatefulProcessor):
    """Of all events with one id the first by ``seq``; those paid before the stream began are known from the initial state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paid = handle.getValueState("paid", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            first = pdf.sort_values("seq", kind="stable").iloc[:1]
            if best is None or first["seq"].iloc[0] < best["seq"].iloc[0]:
                best = first
        if self.paid.exists():
            yield pd.DataFrame()
        else:
            self.paid.update((int(best["seq"].iloc[0]),))
            yield best[list(EVENT)]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.paid.update((-1,))

    def close(self) -> None:
        pass


EVENT = {"seq": "long", "event_id": "string", "user_id": "string", "amount_cents": "int", "currency": "string", "minutes": "double", "reason": "string"}


def stream_billing(events: DataFrame, users: DataFrame, payments: DataFrame) -> DataFrame:
    """The billable events that are to be credited, each ``event_id`` once for ever: those that neither ``payments`` nor an earlier row holds.

    ``payments`` is read once, when the stream first starts, as the initial state; from then on a batch costs what it
    holds, whatever came before. Events that are not billable leave no state, so one of a user who is not known yet
    can still be credited when it comes again.
    """
    named = billable(events, users).select(*[F.col(c).cast(t).alias(c) for c, t in EVENT.items()])
    before = payments.select("event_id").where("event_id is not null").distinct().groupBy("event_id")
    return named.groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=FirstOfEvent(), outputStructType=", ".join(f"{c} {t}" for c, t in EVENT.items()), outputMode="append", timeMode="None", initialState=before)


def billing_sink(payments_path: str, ledger_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes the payment and ledger rows of what ``stream_billing`` gives.

    Every batch owns one directory per table, so a batch that is replayed after a failure writes the same rows again
    in the same place. No history is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for rows, path in zip(credit_rows(batch), (payments_path, ledger_path), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return write


class StaleJobs(StatefulProcessor):
    """Latest state per job and one timer; the timer fires when no update came for the limit.

    A job that was reported stays so: its state is a tombstone, and what it sends later changes nothing.
    """

    def __init__(self, minutes: int = STALE_MINUTES):
        self.limit_ms = minutes * 60 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "user_id string, status string, at_ms long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.job.get()) if self.job.exists() else None
        if last and last[1] == SWEPT:
            yield pd.DataFrame()
            return
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                at = int(pd.Timestamp(r.updated_at).value // 1_000_000)
                if last is None or (at, int(r.seq)) >= last[2:]:
                    last = (r.user_id, r.status, at, int(r.seq))
        self.job.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last[1] in ("queued", "processing"):
            self.handle.registerTimer(last[2] + self.limit_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        user_id, _, at, seq = self.job.get()
        self.job.update((user_id, SWEPT, at, seq))
        yield pd.DataFrame([[key[0], user_id, "failed", "timed out"]], columns=["job_id", "user_id", "status", "error"])

    def close(self) -> None:
        pass


def stream_stale_jobs(updates: DataFrame, minutes: int = STALE_MINUTES, delay: str = "1 minute") -> DataFrame:
    """Jobs ``job_id, user_id, status, updated_at, seq`` that stopped moving, once each; ``seq`` orders updates of one time."""
    return updates.withWatermark("updated_at", delay).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StaleJobs(minutes), outputStructType="job_id string, user_id string, status string, error string",
        outputMode="append", timeMode="EventTime")


class FirstOfRef(StatefulProcessor):
    """Of all requests with one kind and reference, whoever they name, the first by ``seq, id``; later batches add none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.landed = handle.getValueState("landed", "id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = min(rows, key=lambda r: (r.seq, r.id))
        if not self.landed.exists():
            self.landed.update((best.id,))
            yield Row(**{c: best[c] for c in REQUEST})

    def close(self) -> None:
        pass


# The columns of a ledger request.
REQUEST = ["id", "seq", "user_id", "kind", "minutes", "ref"]


class GuardedLedger(StatefulProcessor):
    """Running balance of one user with the refs that already landed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "minutes long")
        self.landed = handle.getMapState("landed", "kind string, ref string", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bal = self.balance.get()[0] if self.balance.exists() else 0
        seen: dict[tuple[str, str], bool] = {}
        # one micro-batch of one user; its order is the request order
        for r in sorted(rows, key=lambda r: (r.seq, r.id)):
            slot = (r.kind, r.ref)
            if slot not in seen:
                seen[slot] = self.landed.containsKey(slot)
            if r.kind != "debit" and seen[slot]:
                continue
            verdict, delta = decide(bal, r.kind, r.minutes, seen[slot])
            if verdict == "accepted":
                seen[slot] = True
                self.landed.updateValue(slot, (r.id,))
            bal += delta
            yield Row(id=r.id, user_id=key[0], verdict=verdict, delta=delta, balance_after=bal)
        self.balance.update((bal,))

    def close(self) -> None:
        pass


def sweep_sink(ledger: Callable[[], DataFrame], swept_path: str, refunds_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores jobs found stale and pays back what they were charged.

    ``ledger`` gives the ledger as it is when a batch runs.  A job is found once, and a replayed batch replaces its
    own two directories, so nothing is paid twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{swept_path}/batch={batch_id}")
        refunds_for(batch.select("job_id", "user_id"), ledger()).write.mode("overwrite").parquet(f"{refunds_path}/batch={batch_id}")
        batch.unpersist()

    return write


def late_rows(arrived: DataFrame, counted: DataFrame, n: str = "n") -> DataFrame:
    """Rows that came after their bucket was closed: what arrived less what the final buckets ``counted`` hold."""
    both = arrived.agg(F.count("*").alias("arrived")).unionByName(counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("counted")), allowMissingColumns=True)
    return both.agg(F.max("arrived").alias("arrived"), F.max("counted").alias("counted")).withColumn("late", F.col("arrived") - F.col("counted"))


def stream_ledger(requests: DataFrame) -> DataFrame:
    """Decisions on requests ``id, seq, user_id, kind, minutes, ref`` (whole minutes) as they arrive.

    As in the batch form, all but debits land once per kind and reference over all users, debits once per user and
    reference.  A micro-batch is ordered by ``seq, id``; batches are taken as they come.
    """
    named = requests.select("id", F.col("seq").cast("bigint").alias("seq"), "user_id", "kind", F.col("minutes").cast("bigint").alias("minutes"), "ref")
    debit = F.coalesce(F.col("kind") == "debit", F.lit(False))
    firsts = named.where(~debit).groupBy("kind", "ref").transformWithState(
        statefulProcessor=FirstOfRef(), outputStructType="id long, seq long, user_id string, kind string, minutes long, ref string",
        outputMode="append", timeMode="None")
    # Debits are known by user and reference, which the ledger of the user sees to; they leave no state before it.
    return firsts.select(*REQUEST).union(named.where(debit).select(*REQUEST)).groupBy("user_id").transformWithState(
        statefulProcessor=GuardedLedger(), outputStructType="id long, user_id string, verdict string, delta long, balance_after long",
        outputMode="append", timeMode="None")


def run_available(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> DataFrame | None:
    """Process what is there now and return the written rows, with the micro-batch in ``batch``.

    Each micro-batch owns one directory, so a replayed one replaces itself.  Rows and checkpoint live below ``path``;
    naming the one of an earlier run resumes it, none takes a new folder.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    out = path or scratch(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink or write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    spark.conf.set(key, before)
    q.awaitTermination()
    if sink is not None:
        return None
    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(stream.schema.fields)).add("batch", LongType())
    return spark.read.schema(schema).parquet(f"{out}/data")

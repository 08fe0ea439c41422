"""Job states kept up to date from a stream of job events.

Two streaming queries, chained by a folder. The first one, `admit`, splits what arrives: an event older than the latest one of
earlier batches by more than `DELAY` is late and is only listed; the others are admitted. The second one folds
admitted events per job in state keyed by buckets of jobs, with event-time timers: a finished job that hears nothing for `RETENTION` is closed,
and its state goes. Both can be stopped and started again: a batch writes a folder of its own number, and what
has been admitted before decides what is late.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta.operators.ledger import state_columns
from attesta.sources.publishing import exists

FIELDS = ("status", "stage", "done")
DELAY = "1 hour"
RETENTION = "2 hours"
#: Fixed value: groups of jobs that are folded together; a restart must find the same number.
BUCKETS = 128


def read_events(spark: SparkSession, path: str, schema, max_files: int | None = 100) -> DataFrame:
    """The files of a folder as a stream: `max_files` in a batch, or all there are."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def job_state_stream(events: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "job_id") -> DataFrame:
    """Streaming fold keyed by job without expiry; state is one row per job, whatever the number of events."""
    return events.groupBy(key).agg(*state_columns(list(fields)))


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def admit(events: DataFrame, folder: str, time: str = "ts", delay: str = DELAY) -> StreamingQuery:
    """Runs over all events there are: admitted ones go to `folder`/admitted, late ones to `folder`/late.

    The bound of a batch is the latest time that earlier batches admitted, less `delay`: one value, read from the
    statistics of their files. A batch that is run again overwrites its own folders with the same rows.
    """
    wait = F.expr(f"INTERVAL {delay}")

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _batches(spark, f"{folder}/admitted")
        latest = None if known is None else known.where(F.col("batch") < number).agg(F.max(time)).first()[0]
        late = F.lit(False) if latest is None else F.col(time) < F.lit(latest) - wait
        for name, rows in (("admitted", batch.where(F.coalesce(~late, F.lit(False)))), ("late", batch.where(F.coalesce(late, F.lit(True))))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return events.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/checkpoints/admit").trigger(availableNow=True).start()


def _latest(old: pd.DataFrame, new: pd.DataFrame, field: str) -> pd.DataFrame:
    """The last event that carried a field, for each job; among equal ones the one that is known already."""
    names = {f"{field}_at": "at", f"{field}_id": "event_id"}
    carried = new.loc[new[f"has_{field}"].eq(True), ["job_id", "at", "event_id", field]].sort_values(["at", "event_id"], kind="stable").drop_duplicates("job_id", keep="last")
    carried[field] = pd.Series([None if pd.isna(v) else str(v) for v in carried[field]], carried.index, dtype=object)
    known = old.loc[old[f"{field}_at"].notna(), ["job_id", *names, field]].rename(columns=names)
    both = [part for part in (carried, known) if len(part)] or [carried]
    last = pd.concat(both).sort_values(["at", "event_id"], kind="stable").drop_duplicates("job_id", keep="last")
    return last.rename(columns={v: k for k, v in names.items()})


def _fold(fields: tuple[str, ...], finished: str, keep: float):
    """Per job and field the value of the last event that carried it; a time of its own for every finished job.

    The state of a bucket is a table of its jobs that aren't closed, its timer the earliest time at which one of them is.
    """
    columns = ["job_id", "events", "newest", "due", *[c for f in fields for c in (f"{f}_at", f"{f}_id", f)]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
        now = state.getCurrentWatermarkMs()
        jobs, touched = old, old["job_id"].isin([])
        if not state.hasTimedOut:
            new = pd.concat(list(batches), ignore_index=True)
            seen = new.groupby("job_id", dropna=False, sort=False).agg(n=("at", "size"), latest=("at", "max")).reset_index()
            jobs = old[["job_id", "events", "newest", "due"]].merge(seen, "outer", "job_id")
            touched = jobs["n"].notna()
            jobs["events"] = jobs["events"].astype("float64").fillna(0).astype("int64") + jobs["n"].fillna(0).astype("int64")
            jobs["newest"] = jobs[["newest", "latest"]].astype("float64").max(axis=1)
            for f in fields:
                jobs = jobs.merge(_latest(old, new, f), "left", "job_id")
            over = (jobs[fields[0]] == finished).to_numpy()
            due = np.where(over, np.maximum(((jobs["newest"] + keep) * 1000).astype("int64"), now + 1), -1)
            jobs["due"] = np.where(touched, due, jobs["due"].astype("float64").fillna(-1).astype("int64"))
        # Jobs that aren't heard of in this batch are closed as the watermark passes them.
        closed = ~touched & (jobs["due"] >= 0) & (jobs["due"] < now)
        left = jobs.loc[~closed, columns].reset_index(drop=True)
        if len(left):
            state.update((_packed(left, fields),))
            timed = left.loc[left["due"] >= 0, "due"]
            if len(timed):
                state.setTimeoutTimestamp(max(int(timed.min()), now + 1))
        else:
            state.remove()
        out = jobs[touched | closed]
        yield pd.DataFrame({"job_id": out["job_id"], **{f: out[f].astype(object).where(out[f].notna(), None) for f in fields}, "updated": out["newest"].astype("float64"), "events": out["events"].astype("int64"), "closed": closed[out.index].astype(bool)})

    return run


def _packed(jobs: pd.DataFrame, fields: tuple[str, ...]) -> bytes:
    kinds = [("job_id", pa.string()), ("events", pa.int64()), ("newest", pa.float64()), ("due", pa.int64())]
    kinds += [x for f in fields for x in ((f"{f}_at", pa.float64()), (f"{f}_id", pa.int64()), (f, pa.string()))]
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(jobs, pa.schema(kinds), preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def fold_jobs(events: DataFrame, fields: tuple[str, ...] = FIELDS, finished: str = "done", retention: str = RETENTION, delay: str = DELAY) -> DataFrame:
    """(job_id, *fields as text, updated, events, closed): changed jobs of each batch, and closed ones once.

    events(job_id, event_id, ts, and for each field its value and has_<field>): the fold of `ledger.job_states`, in keyed state. A job whose
    first field is `finished` is closed when the watermark passes its last event by `retention`; an event after that
    opens it anew. State holds three values for each field and is bounded by the jobs that aren't closed. Jobs are folded by buckets
    of their hashes, since a call, a state and a timer for every job take far longer than its few events.
    """
    keep = pd.Timedelta(retention) / timedelta(seconds=1)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("bucket"), "job_id", "event_id", "ts", F.col("ts").cast("double").alias("at"), *fields, *[F.col(f"has_{f}") for f in fields])
    out = ", ".join(["job_id string", *[f"{f} string" for f in fields], "updated double", "events long", "closed boolean"])
    return timed.groupBy("bucket").applyInPandasWithState(_fold(fields, finished, keep), out, "jobs binary", "update", GroupStateTimeout.EventTimeTimeout)


def keep_states(states: DataFrame, folder: str, more: bool = False) -> StreamingQuery:
    """Runs to the end of what is there; every batch's changes go to a folder of its own number.

    Where `more` is to come at once, no empty batch follows that would close jobs before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    conf, name = states.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(not more).lower())
    try:
        return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoints/fold").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each life of a job: one for a job that was never closed."""
    rows = spark.read.parquet(f"{folder}/states")
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("job_id", "batch")]), F.struct("batch", F.col("closed").cast("int"))).alias("s")).select("job_id", "s.*")


def write_states(states: DataFrame, upsert, checkpoint: str, trigger: dict | None = None):
    """Emit changed jobs per micro-batch to an idempotent `upsert(batch, epoch)`."""
    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert)
    return writer.trigger(**(trigger or {"availableNow": True}))

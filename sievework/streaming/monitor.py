"""Monitors of polled status feeds and logs as Structured Streaming queries.

State is bounded: a reference's last status goes after a time without polls, of an event that was given only a flag stays (or
goes as well, see OneShot), duplicates are remembered within the watermark only, of log lines the last n are kept, and rows that
were flushed are looked up in what was written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

POLLS = "poll_ts timestamp, ref string, status string, sent timestamp, score double"
TERMINAL = ("COMPLETE", "ERROR", "CANCELED")
CHANGES = "ref string, poll_ts timestamp, before string, status string, terminal boolean, minutes double, minutes_low double"


def polls(spark: SparkSession, path: str, schema: str = POLLS, files_per_trigger: int = 1) -> DataFrame:
    """A folder of polls, one file a poll or more, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def without_repeats(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Late and repeated polls: one row per ref, status and poll time within the watermark."""
    return stream.withWatermark("poll_ts", delay).dropDuplicatesWithinWatermark(["ref", "status", "poll_ts"])


class Changes(StatefulProcessor):
    """Keeps the last status per ref; gives a row when it changes.

    A ref whose first poll is already terminal gives nothing: when it ended isn't known. A terminal change has the minutes
    since it was sent, and the lower bound at the poll before. A ref that isn't polled for `hours` of event time is given up.
    """

    def __init__(self, hours: float = 48.0, terminal: tuple[str, ...] = TERMINAL):
        self.hours, self.terminal = hours, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at double, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values("poll_ts", kind="stable")
        known = self.last.get() if self.last.exists() else None
        status, at, done = known if known is not None else (None, None, False)
        out = []
        for r in polls.itertuples():
            now = r.poll_ts.timestamp()
            if done or at is not None and now < at:
                continue  # after the end, or a poll older than what is known
            ends = r.status in self.terminal
            if status is not None and r.status != status:
                since = None if not ends or pd.isna(r.sent) else (r.poll_ts - r.sent).total_seconds() / 60
                low = None if since is None else max(0.0, since - (now - at) / 60)
                out.append((key[0], r.poll_ts, status, r.status, ends, since, low))
            status, at, done = r.status, now, ends
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.last.update((status, at, done))
        self.handle.registerTimer(int((at + self.hours * 3600) * 1000))
        yield pd.DataFrame(out, columns=["ref", "poll_ts", "before", "status", "terminal", "minutes", "minutes_low"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["ref", "poll_ts", "before", "status", "terminal", "minutes", "minutes_low"])

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame, delay: str = "1 hour", hours: float = 48.0) -> DataFrame:
    """Status changes per ref (see Changes). The session needs the RocksDB state store."""
    rocksdb(stream.sparkSession)
    keyed = stream.withWatermark("poll_ts", delay).select("ref", "poll_ts", "status", "sent")
    return keyed.groupBy("ref").transformWithStateInPandas(statefulProcessor=Changes(hours), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def status_changes_batch(polled: DataFrame) -> DataFrame:
    """The same over a finished table of polls, by windows."""
    from pyspark.sql import Window as W

    w = W.partitionBy("ref").orderBy("poll_ts", "status")
    rows = polled.dropDuplicates(["ref", "poll_ts", "status"]).withColumns({"before": F.lag("status").over(w), "_at": F.lag("poll_ts").over(w), "_ended": F.max(F.col("status").isin(*TERMINAL)).over(w.rowsBetween(W.unboundedPreceding, -1))})
    changed = rows.where(F.col("before").isNotNull() & (F.col("before") != F.col("status")) & ~F.coalesce("_ended", F.lit(False)))
    ends = F.col("status").isin(*TERMINAL)
    seconds = lambda a, b: a.cast("double") - b.cast("double")
    since = F.when(ends, seconds(F.col("poll_ts"), F.col("sent")) / 60)
    low = F.greatest(F.lit(0.0), since - seconds(F.col("poll_ts"), F.col("_at")) / 60)
    return changed.select("ref", "poll_ts", "before", "status", ends.alias("terminal"), since.alias("minutes"), F.when(since.isNotNull(), low).alias("minutes_low"))


ONE_SHOT = "ref string, at long, event string, sent long, score double"


class OneShot(StatefulProcessor):
    """Gives one row per ref for the ref's lifetime: the first terminal poll before its deadline, else GAVE_UP at the deadline.

    The deadline is a timer in event time, so giving up needs no further poll of the ref, only that the watermark passes it; and
    which polls came in which batch has no effect. After its row a ref keeps a flag and nothing else; with `forget` (microseconds)
    the flag goes when the ref wasn't polled for that long, and a later poll would be a new lifetime.

    A key is a bucket of refs with one list of their states and one timer, for what is due first: calls to the state store cost
    more than all else, and so there are a few per bucket and batch instead of a few per ref.
    """

    OUT = ["ref", "at", "event", "sent", "score"]

    def __init__(self, terminal: tuple[str, ...] = TERMINAL, forget: int | None = None):
        self.terminal, self.forget = terminal, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # fired; deadline, sent and the last poll in microseconds
        self.known = handle.getListState("known", "ref string, fired boolean, deadline long, sent long, last long")

    def _load(self) -> dict:
        return {ref: tuple(state) for ref, *state in self.known.get()} if self.known.exists() else {}

    def _due(self, fired: bool, deadline: int | None, last: int) -> int | None:
        """In milliseconds, when the watermark ends something for the ref."""
        at = deadline if not fired else None if self.forget is None else last + self.forget
        return None if at is None else -(-at // 1000)

    def _keep(self, known: dict) -> None:
        if known:
            self.known.put([(ref, *state) for ref, state in known.items()])
        else:
            self.known.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        due = [x for fired, deadline, _, last in known.values() if (x := self._due(fired, deadline, last)) is not None]
        if due:
            self.handle.registerTimer(min(due))

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.OUT).astype({"at": "Int64", "sent": "Int64", "score": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["poll_us", "status"], kind="stable")
        known, out = self._load(), []
        for ref, at, status, sent_us, deadline_us, score in zip(*(polls[c].tolist() for c in ("ref", "poll_us", "status", "sent_us", "deadline_us", "score"))):
            fired, deadline, sent, last = known.get(ref, (False, None, None, 0))
            at = int(at)
            if deadline is None and not pd.isna(deadline_us):
                sent, deadline = int(sent_us), int(deadline_us)
            if not fired and status in self.terminal and (deadline is None or at < deadline):
                fired = True
                out.append((ref, at, status, sent if sent is not None or pd.isna(sent_us) else int(sent_us), None if pd.isna(score) else float(score)))
            known[ref] = fired, deadline, sent, max(last, at)
        self._keep(known)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, out, passed = self._load(), [], max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for ref, (fired, deadline, sent, last) in list(known.items()):
            due = self._due(fired, deadline, last)
            if due is None or due > passed:
                continue
            if fired:
                del known[ref]
            else:
                out.append((ref, deadline, "GAVE_UP", sent, None))
                known[ref] = True, deadline, sent, last
        self._keep(known)
        yield self._rows(out)

    def close(self) -> None:
        pass


def rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store: set for the session where it still has the default one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def one_shot(stream: DataFrame, delay: str = "6 hours", terminal: tuple[str, ...] = TERMINAL, give_up: str | None = None, forget_hours: float | None = None, buckets: int = 512) -> DataFrame:
    """(ref, poll_ts, event, sent, score): one row per ref. event: the status of its first terminal poll; with give_up (an
    interval after `sent`) GAVE_UP at that time where no terminal poll came before it. buckets: into which refs are dealt; a task holds one at a time. See OneShot."""
    rocksdb(stream.sparkSession)
    deadline = F.lit(None).cast("long") if give_up is None else F.unix_micros(F.col("sent") + F.expr(f"interval {give_up}"))
    bucket = F.pmod(F.xxhash64("ref"), F.lit(buckets)).alias("bucket")
    rows = stream.withWatermark("poll_ts", delay).select(bucket, "ref", "poll_ts", "status", F.unix_micros("poll_ts").alias("poll_us"), F.unix_micros("sent").alias("sent_us"), deadline.alias("deadline_us"), F.col("score").cast("double").alias("score"))
    made = OneShot(terminal, None if forget_hours is None else int(forget_hours * 3600e6))
    events = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=made, outputStructType=ONE_SHOT, outputMode="Append", timeMode="EventTime")
    return events.select("ref", F.timestamp_micros("at").alias("poll_ts"), "event", F.timestamp_micros("sent").alias("sent"), "score")


def key_lines(stream: DataFrame, words: list[str]) -> DataFrame:
    """Lines with any of the words; a stream gives only new ones."""
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.col("line").contains(w)
    return stream.where(any_word)


def rates(stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", ts: str = "ts", done: str = "done") -> DataFrame:
    """Progress per worker and tumbling window: rows done in it, and per minute."""
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "worker").agg((F.max(done) - F.min(done)).alias("rows"), F.count("*").alias("lines"))
    minutes = (F.col("w.end").cast("double") - F.col("w.start").cast("double")) / 60
    return out.select(F.col("w.start").alias("start"), "worker", "rows", "lines", (F.col("rows") / minutes).alias("per_minute"))


def flush(stream: DataFrame, path: str, checkpoint: str, uid: str = "uid", every: str | None = None, buckets: int = 64, ts: str | None = None, keep: str = "1 hour"):
    """Writes rows of new uids, batch by batch, to path/batch=<n>.

    What was written is the memory: beside the rows lie their uids, path/_uids/bucket=<b>/batch=<n>, dealt by a hash; a batch is
    compared (anti join) with those buckets only that it touches, so the stream itself keeps no uids. With `ts`, an event time,
    repeats within `keep` are dropped by the stream's state before, which forgets them after that time. A batch that runs again
    after a failure isn't compared with its own uids, gives the same rows and replaces its own output.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark, index = batch.sparkSession, f"{path}/_uids"
        bucket = F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int")
        rows = held = batch.dropDuplicates([uid]).persist()  # read several times; recomputed where an executor is lost
        try:
            touched = [r.b for r in rows.select(bucket.alias("b")).distinct().collect()]  # `buckets` numbers at most
            if touched and _exists(spark, index):
                kept = spark.read.schema(f"_seen {rows.schema[uid].dataType.simpleString()}, bucket int, batch long").parquet(index)
                seen = kept.where(F.col("bucket").isin(touched) & (F.col("batch") != n))
                rows = rows.join(seen, (bucket == seen["bucket"]) & rows[uid].eqNullSafe(seen["_seen"]), "left_anti")
            rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
            made = spark.read.schema(batch.schema).parquet(f"{path}/batch={n}").select(F.col(uid).alias("_seen"), bucket.alias("bucket"), F.lit(n).cast("long").alias("batch"))
            # One file a bucket.
            made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(index)
        finally:
            held.unpersist()

    once = stream if ts is None else stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([uid])
    out = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remaining(units: DataFrame, done: DataFrame, uid: str = "uid") -> DataFrame:
    """Units that a restart has left to do."""
    return units.join(done.select(uid).distinct(), uid, "left_anti")


class LastLines(StatefulProcessor):
    """Keeps the last n lines per worker, by time and then text, across batches and restarts; gives them anew, under the next
    version, whenever one of them is new."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "us long, line string")
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(x) for x in self.lines.get()] if self.lines.exists() else []
        best = list(before)
        for part in rows:  # only n lines are held, however long the batch is
            best = sorted(best + [(int(a), b) for a, b in part[["us", "line"]].itertuples(index=False)])[-self.n :]
        out = []
        if best != before:
            version = (self.version.get()[0] if self.version.exists() else 0) + 1
            self.lines.put(best)
            self.version.update((version,))
            out = [(key[0], version, len(best) - k, us, line) for k, (us, line) in enumerate(best)]
        yield pd.DataFrame(out, columns=["worker", "version", "place", "us", "line"]).astype({"version": "int64", "place": "int32", "us": "int64"})

    def close(self) -> None:
        pass


def last_lines(lines: DataFrame, n: int = 40) -> DataFrame:
    """(worker, ts, line) as a stream to (worker, version, place, ts, line): each worker's last n lines after each batch that
    changes them, place 1 being the last. The highest version of a worker is its present state (`newest`)."""
    rocksdb(lines.sparkSession)
    rows = lines.select(F.col("worker").cast("string").alias("worker"), F.unix_micros("ts").alias("us"), "line").where("us is not null and line is not null")
    kept = rows.groupBy("worker").transformWithStateInPandas(
        statefulProcessor=LastLines(n), outputStructType="worker string, version long, place int, us long, line string", outputMode="Append", timeMode="None"
    )
    return kept.select("worker", "version", "place", F.timestamp_micros("us").alias("ts"), "line")


def newest(versions: DataFrame) -> DataFrame:
    """The rows of each worker's highest version in what `last_lines` wrote."""
    top = versions.groupBy("worker").agg(F.max("version").alias("version"))
    return versions.join(top, ["worker", "version"], "left_semi")

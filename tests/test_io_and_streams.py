import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.operators import quality
from sievework.plans import composites
from sievework.sources import readers, sinks
from sievework.streaming import monitor

LABELS = ["ACL", "Baker's", "PF OA"]


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def root(tmp_path):
    head = "uid," + ",".join(LABELS)
    put(f"{tmp_path}/a.csv", f"{head}\n001,0.1,0.2,nan\n002,0.9,,0.5\n")
    put(f"{tmp_path}/b.csv", "uid,ACL\n001,0.1\n")
    put(f"{tmp_path}/dup.csv", f"{head}\n1,0.1,0.2,0.3\n1,0.1,0.2,0.3\n")
    put(f"{tmp_path}/high.csv", f"{head}\n1,1.5,0.2,0.3\n")
    put(f"{tmp_path}/good.csv", f"{head}\n1,0.5,0.2,0.3\n")
    return str(tmp_path)


def test_sources(spark, root):
    index = spark.createDataFrame([("001",), ("002",), ("003",)], "uid string")
    files = {"a": "a.csv", "b": "b.csv", "c": "none.csv"}
    got, notes = readers.load_sources(spark, root, files, ["a", "b", "c"], index, LABELS)
    assert len(notes) == 2 and got.count() == 9
    cells = {(r.uid, r.label): r.value for r in got.collect()}
    assert cells["001", "PF OA"] is None and cells["002", "ACL"] == 0.9 and cells["003", "ACL"] is None
    assert {r.label: r.known for r in readers.source_coverage(got).collect()} == {"ACL": 2, "Baker's": 1, "PF OA": 1}
    with pytest.raises(quality.DataError):
        readers.load_sources(spark, root, files, ["x"], index, LABELS)
    with pytest.raises(quality.DataError):
        readers.load_sources(spark, root, files, ["b", "c"], index, LABELS)


@pytest.mark.parametrize("name", ["b", "dup", "high"])
def test_teachers_refuse(spark, root, name):
    with pytest.raises(quality.DataError):
        readers.load_teachers(spark, {"t": f"{root}/{name}.csv"}, LABELS)


def test_teachers_load(spark, root):
    assert readers.load_teachers(spark, {"t": f"{root}/good.csv"}, LABELS).count() == 3


def test_oof_names(spark, tmp_path):
    head = "uid," + ",".join(f"{k}__ACL" for k in ("pred", "y", "w"))
    for name in ("v1_fold0_oof.csv", "v1_fold1_oof.csv", "v1_fold0_ep3_oof.csv"):
        put(f"{tmp_path}/{name}", f"{head}\n1,0.5,1,1\n")
    got = readers.read_oof(spark, str(tmp_path), ["uid"], ["ACL"])
    assert sorted((r.version, r.fold, r.epoch) for r in got.collect()) == [("v1", 0, None), ("v1", 1, None)]
    ep = readers.read_oof(spark, str(tmp_path), ["uid"], ["ACL"], epochs=True)
    assert [(r.fold, r.epoch) for r in ep.collect()] == [(0, 3)]
    assert readers.oof_long(got, ["ACL"], ["uid", "fold"]).count() == 2


def test_coded_and_described(spark, tmp_path):
    put(f"{tmp_path}/r.txt", "ID|SIDE|V00\n9|1: Right|2.1: much\n9|2: Left|.: Missing\n")
    got = readers.read_coded(spark, f"{tmp_path}/r.txt", ["ID", "V00"]).collect()
    assert got[0].V00 == "2.1: much"
    put(f"{tmp_path}/d.tsv", "key\tname\nThe key\tThe name\nk1\tn1\n")
    assert [r.key for r in readers.read_described(spark, f"{tmp_path}/d.tsv", ["key"], "key").collect()] == ["k1"]


def test_manifests_and_discovery(spark, tmp_path):
    cols = [c.split()[0] for c in readers.MANIFEST.split(", ")]
    put(f"{tmp_path}/m/manifest_shard0.csv", ",".join(cols) + "\nu,s,3,L,0,b,0,1,001011,c02\nv,s,3,L,0,b,1,0,1,c02\nw,s,3,L,0,b,1,1,1,\n")
    got = readers.read_manifests(spark, f"{tmp_path}/m/manifest_shard*.csv").collect()
    assert [(r.uid, r.mask) for r in got] == [("u", "001011")]
    assert readers.first_existing(spark, [f"{tmp_path}/x", f"{tmp_path}/m"]).endswith("/m")
    assert len(readers.shallow_glob("/r", "a.csv", 2)) == 3
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [f"{tmp_path}/x"])


def test_views_skip_unfinished(spark, tmp_path):
    df = spark.createDataFrame([("s", "v", "u", "a", float("nan"))], "shard string, view string, uid string, label string, p double")
    df.coalesce(1).write.parquet(f"{tmp_path}/v")
    part = next(f for f in os.listdir(f"{tmp_path}/v") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/v/{part}", f"{tmp_path}/v/x.parquet")
    with open(f"{tmp_path}/v/x.parquet", "rb") as f, open(f"{tmp_path}/v/y.tmp.parquet", "wb") as g:
        g.write(f.read())
    got = readers.read_views(spark, f"{tmp_path}/v").collect()
    assert len(got) == 1 and got[0].p is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "uid int, k string, v double")
    assert sinks.checksum(df).first() == sinks.checksum(df.repartition(3)).first()
    assert sinks.checksum(df).first() != sinks.checksum(df.limit(1)).first()
    gap = sinks.compare(df, df.withColumn("v", F.col("v") + 0.25), ["uid"], ["v"]).first()
    assert gap.max_diff == 0.25 and gap.unmatched == 0
    path = f"{tmp_path}/cache"
    assert sinks.cached(spark, path, lambda: df.where("false")).count() == 0 and not os.path.exists(path)
    calls = []
    for _ in range(2):
        assert sinks.cached(spark, path, lambda: calls.append(1) or df).count() == 2
    assert len(calls) == 1
    sinks.replace_partitions(df, f"{tmp_path}/p", ["k"])
    sinks.replace_partitions(df.where("k = 'a'").withColumn("v", F.lit(9.0)), f"{tmp_path}/p", ["k"])
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {"a": 9.0, "b": None}
    sinks.write_report(df, f"{tmp_path}/rep")
    sinks.write_csv(df, f"{tmp_path}/csv")
    sinks.append_events(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 4
    assert sinks.markdown(df).splitlines()[0] == "| uid | k | v |"


def test_build_targets(spark):
    studies = spark.createDataFrame([(i, f"g{i // 2}", i < 6) for i in range(20)], "uid int, group string, is_gold boolean")
    src = spark.createDataFrame([(i, s, "a", (i * 7 + k) % 10 / 10) for i in range(20) for k, s in enumerate(("x", "y"))], "uid int, source string, label string, value double")
    gold = spark.createDataFrame([(i, "a", float(i % 2)) for i in range(6)], "uid int, label string, y double")
    t, score = composites.build_targets(studies, src, gold)
    got = {r.uid: r for r in t.collect()}
    assert len(got) == 20 and all(got[i].w == 8.0 and got[i].y == i % 2 for i in range(6))
    assert score.first().auc is not None and {r.fold for r in got.values()} <= set(range(5))
    assert all(got[i].fold == got[i + 1].fold for i in range(0, 20, 2))


T0 = datetime(2024, 1, 1)


def write_polls(folder, n, polls):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{n:03}.json", "w") as f:
        for ref, minute, status in polls:
            f.write(json.dumps({"poll_ts": (T0 + timedelta(minutes=minute)).isoformat(), "ref": ref, "status": status, "sent": T0.isoformat()}) + "\n")
    os.utime(f"{folder}/{n:03}.json", (1_700_000_000 + n, 1_700_000_000 + n))


BATCHES = [
    [("a", 1, "PENDING"), ("b", 1, "COMPLETE"), ("c", 1, "PENDING")],
    [("a", 6, "RUNNING"), ("b", 6, "COMPLETE"), ("c", 6, "PENDING")],
    [("a", 11, "COMPLETE"), ("a", 11, "COMPLETE"), ("c", 11, "ERROR")],
    [("a", 16, "COMPLETE"), ("c", 16, "ERROR")],
]
WANT = [("a", "PENDING", "RUNNING", False, None, None), ("a", "RUNNING", "COMPLETE", True, 11.0, 6.0), ("c", "PENDING", "ERROR", True, 11.0, 6.0)]


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_status_changes(spark, tmp_path):
    for n, polls in enumerate(BATCHES):
        write_polls(f"{tmp_path}/polls", n, polls)
    rows = drain(monitor.status_changes(monitor.polls(spark, f"{tmp_path}/polls")), "changes", tmp_path)
    key = lambda r: (r.ref, r.before, r.status, r.terminal, r.minutes, r.minutes_low)
    assert sorted(map(key, rows), key=str) == sorted(WANT, key=str)
    batch = monitor.status_changes_batch(spark.read.schema(monitor.POLLS).json(f"{tmp_path}/polls"))
    assert sorted(map(key, batch.collect()), key=str) == sorted(WANT, key=str)


def test_one_shot_and_repeats(spark, tmp_path):
    for n, polls in enumerate(BATCHES):
        write_polls(f"{tmp_path}/polls", n, polls)
    rows = drain(monitor.one_shot(monitor.polls(spark, f"{tmp_path}/polls")), "once", tmp_path)
    assert sorted(r.ref for r in rows) == ["a", "b", "c"]
    rows = drain(monitor.without_repeats(monitor.polls(spark, f"{tmp_path}/polls")), "fresh", tmp_path)
    assert len(rows) == 10


def to_files(df, folder):
    """Runs a stream into a folder, going on where an earlier run of it ended; all rows so far."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_one_shot_fires_once_and_gives_up(spark, tmp_path):
    """24 hourly polls of an ended ref give one row, over batches and a restart; a ref that falls silent is given up by the
    watermark; an end after the deadline comes too late; a late poll of an earlier end still counts within the delay."""
    hour = [[("a", 60 * h + 60, "COMPLETE")] for h in range(24)]
    hour[0] += [("silent", 61, "PENDING"), ("slow", 62, "RUNNING"), ("late", 62, "RUNNING")]
    hour[5] += [("late", 200, "ERROR")]
    hour[11] += [("slow", 60 * 11 + 65, "COMPLETE"), ("late", 60 * 11 + 70, "COMPLETE")]
    for part, hours in enumerate((hour[:12], hour[12:])):
        for n, polls in enumerate(hours):
            write_polls(f"{tmp_path}/polls", 100 * part + n, polls)
        stream = monitor.one_shot(monitor.polls(spark, f"{tmp_path}/polls"), delay="6 hours", give_up="10 hours")
        found = to_files(stream, f"{tmp_path}/once").collect()
    minutes = lambda t: (t - T0).total_seconds() / 60
    assert sorted((r.ref, r.event, minutes(r.poll_ts)) for r in found) == [("a", "COMPLETE", 60), ("late", "ERROR", 200), ("silent", "GAVE_UP", 600), ("slow", "GAVE_UP", 600)]


def test_last_lines(spark, tmp_path):
    """The last three of all lines so far per worker, with a late one, over a restart."""
    lines = [("w", m, f"loss {m}") for m in (1, 2, 3, 9)] + [("v", 1, "loss a"), ("v", 1, "loss b"), ("w", 4, "other")] + [("w", 5, "loss late"), ("u", 7, "loss u"), ("w", None, "loss none")]
    for n, part in enumerate((lines[:3], lines[3:7], lines[7:])):
        rows = [{"worker": w, "ts": None if m is None else (T0 + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%S"), "line": x} for w, m, x in part]
        put(f"{tmp_path}/lines/{n}.json", "\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("worker string, ts timestamp, line string").json(f"{tmp_path}/lines")
        kept = monitor.last_lines(monitor.key_lines(stream, ["loss"]), 3)
        out = to_files(kept, f"{tmp_path}/kept")
    got = monitor.newest(out).orderBy("worker", "place").collect()
    assert [(r.worker, r.place, r.line) for r in got] == [("u", 1, "loss u"), ("v", 1, "loss b"), ("v", 2, "loss a"), ("w", 1, "loss 9"), ("w", 2, "loss late"), ("w", 3, "loss 3")]


def test_flush_keeps_no_uids_in_its_state(spark, tmp_path):
    """Many batches with repeats: no uid twice, no state at all; a batch that runs again replaces its own output."""
    for n in range(12):
        write_polls(f"{tmp_path}/polls", n, [(f"u{k}", 60 + n, "X") for k in range(n, n + 4)])
    q = monitor.flush(monitor.polls(spark, f"{tmp_path}/polls"), f"{tmp_path}/out", f"{tmp_path}/cp", uid="ref", buckets=4)
    q.awaitTermination(240)
    assert q.exception() is None and all(not p["stateOperators"] for p in map(dict, q.recentProgress))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.ref for r in out.collect()) == sorted(f"u{k}" for k in range(15))
    commits = sorted((int(f), f) for f in os.listdir(f"{tmp_path}/cp/commits") if f.isdigit())
    for name in (commits[-1][1], f".{commits[-1][1]}.crc"):  # as if the last batch had failed after writing
        if os.path.exists(f"{tmp_path}/cp/commits/{name}"):
            os.remove(f"{tmp_path}/cp/commits/{name}")
    monitor.flush(monitor.polls(spark, f"{tmp_path}/polls"), f"{tmp_path}/out", f"{tmp_path}/cp", uid="ref", buckets=4).awaitTermination(240)
    assert sorted(r.ref for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(f"u{k}" for k in range(15))


def test_flush_with_time_to_live(spark, tmp_path):
    """With an event time the stream drops near repeats itself and what it wrote tells it of old ones."""
    for n in range(8):
        write_polls(f"{tmp_path}/polls", n, [("same", 60 + 300 * n, "X"), (f"u{n}", 60 + 300 * n, "X")])
    q = monitor.flush(monitor.polls(spark, f"{tmp_path}/polls"), f"{tmp_path}/out", f"{tmp_path}/cp", uid="ref", ts="poll_ts", keep="1 hour")
    q.awaitTermination(240)
    assert q.exception() is None
    assert sorted(r.ref for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(["same", *(f"u{n}" for n in range(8))])
    assert max(dict(p)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4


def test_flush_resumes(spark, tmp_path):
    for n, polls in enumerate(BATCHES[:2]):
        write_polls(f"{tmp_path}/polls", n, polls)
    for more in (None, 2):
        if more:
            write_polls(f"{tmp_path}/polls", more, [("a", 20, "X"), ("z", 20, "X")])
        q = monitor.flush(monitor.polls(spark, f"{tmp_path}/polls"), f"{tmp_path}/out", f"{tmp_path}/cp", uid="ref")
        q.awaitTermination(120)
        assert q.exception() is None
    done = spark.read.parquet(f"{tmp_path}/out/batch=*")
    assert sorted(r.ref for r in done.collect()) == ["a", "b", "c", "z"]
    units = spark.createDataFrame([("a",), ("q",)], "ref string")
    assert [r.ref for r in monitor.remaining(units, done, "ref").collect()] == ["q"]


def test_rates(spark):
    df = spark.createDataFrame([(T0 + timedelta(minutes=m), "w", m * 10) for m in (0, 1, 4, 6, 9)], "ts timestamp, worker string, done int")
    got = sorted((r.rows, r.lines) for r in monitor.rates(df).collect())
    assert got == [(30, 2), (40, 3)]

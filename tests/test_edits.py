"""Streams over files that change in place, and the quiet period."""

import json
import os
import time

import pytest

from runledger.streaming import edits, quiet


def write(path, text, at):
    path.write_text(text)
    os.utime(path, (at, at))


def drain(stream, folder, name):
    """All that is new, as the batches of one run with this checkpoint."""
    batches = []
    q = (stream.writeStream.foreachBatch(lambda df, i: batches.append((i, sorted((os.path.basename(r.path), r.kind, r.length) for r in df.collect()))))
         .option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start())
    q.awaitTermination(90)
    assert q.exception() is None
    return [b for _, b in batches if b]


def test_an_overwrite_in_place_starts_a_batch(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    write(data / "a.sqlite", "one", 1000)
    write(data / "b.sqlite", "two", 1000)
    write(data / ".hidden", "x", 1000)
    stream = lambda: edits.watch_edits(spark, [str(data), str(tmp_path / "absent")])
    assert drain(stream(), tmp_path, "cp") == [[("a.sqlite", "created", 3), ("b.sqlite", "created", 3)]]
    assert drain(stream(), tmp_path, "cp") == []
    write(data / "a.sqlite", "longer", 1000)
    assert drain(stream(), tmp_path, "cp") == [[("a.sqlite", "modified", 6)]]
    write(data / "a.sqlite", "LONGER", 2000)  # same length, other time
    (data / "b.sqlite").unlink()
    assert drain(stream(), tmp_path, "cp") == [[("a.sqlite", "modified", 6), ("b.sqlite", "deleted", None)]]
    assert drain(stream(), tmp_path, "cp") == []


def test_a_replay_gives_the_same_batch(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    write(data / "a", "one", 1000)
    stream = lambda: edits.watch_edits(spark, [str(data)])
    drain(stream(), tmp_path, "cp")
    write(data / "a", "second", 2000)
    seen = []

    def fail(df, i):
        seen.append(sorted((r.path, r.kind, r.length, r.modified) for r in df.collect()))
        raise RuntimeError("lost")

    q = stream().writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination(90)
    # The file moves on before the batch is tried again.
    write(data / "a", "third time", 3000)
    batches = []
    q = (stream().writeStream.foreachBatch(lambda df, i: batches.append(sorted((r.path, r.kind, r.length, r.modified) for r in df.collect())))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(90)
    assert batches[0] == seen[0] and batches[0][0][2] == 6
    # Whatever came since is the next batch, of this run or the next.
    rest = [b for b in batches[1:] if b] or drain(stream(), tmp_path, "cp")
    assert len(rest) == 1 and rest[0][0][2] == 10


def test_differences():
    before, after = {"a": [1, 1], "b": [2, 2], "c": [3, 3]}, {"a": [1, 1], "b": [2, 9], "d": [4, 4]}
    assert [(p, k, n) for p, k, n, _ in edits.differences(before, after)] == [("b", "modified", 2), ("c", "deleted", None), ("d", "created", 4)]
    assert json.loads(json.dumps(after)) == after


def test_bursts_are_released_once_after_the_quiet_period(spark, tmp_path):
    data = tmp_path / "events"
    data.mkdir()
    events = spark.readStream.schema("path string, modified timestamp").json(str(data))
    got = []
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = None
    try:
        released = quiet.after_quiet(spark, events, 4000)
        q = (released.writeStream.foreachBatch(lambda df, i: got.extend((time.time(), r.path, r.n_events, r.last_change.second) for r in df.collect()))
             .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start())

        def burst(name, rows):
            # Written aside and moved in, so that the stream never sees a half.
            (tmp_path / name).write_text("\n".join(json.dumps({"path": p, "modified": f"2024-01-01T00:00:{s:02}"}) for p, s in rows))
            (tmp_path / name).rename(data / f"{name}.json")

        burst("one", [("a", 1), ("a", 3), ("b", 2)])
        for i in range(5):  # a keeps changing, so b comes first
            time.sleep(1.5)
            burst(f"more{i}", [("a", 10 + i)])
        last = time.time()
        deadline = last + 90
        while len(got) < 2 and time.time() < deadline:
            time.sleep(0.3)
            assert q.exception() is None
        # Nothing is released twice.
        time.sleep(5)
        assert [(p, n, s) for _, p, n, s in got] == [("b", 1, 2), ("a", 7, 14)]
        assert got[1][0] - last >= 3.5
        burst("again", [("b", 30)])
        deadline = time.time() + 90
        while len(got) < 3 and time.time() < deadline:
            time.sleep(0.3)
        assert [(p, n, s) for _, p, n, s in got][2:] == [("b", 1, 30)]
    finally:
        if q is not None:
            q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")




def test_a_burst_of_overwrites_is_one_refresh(spark, tmp_path):
    from runledger import Ledger, LedgerConfig, Metric
    from runledger.sources.databases import SourceDatabase
    from runledger.streaming.ingest import start_edit_stream

    def put(name, table, schema, data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / name / table))

    runs = lambda v: put("r", "SingleFileReport", "Name string, `System.Time.s` double, Metric double", [("a_b_c_1", 1.0, float(v))])
    runs(1)
    put("meta", "Metadata_Sample", "SampleName_ID string, ProjectID string, CreationDate string", [])
    put("meta", "Metadata_Project", "ProjectID string, TimeRange string", [])
    ledger = Ledger(spark, str(tmp_path / "root"), SourceDatabase("r", str(tmp_path / "in" / "r")), SourceDatabase("meta", str(tmp_path / "in" / "meta")),
                    LedgerConfig(metrics=(Metric("Metric", "Metric", "A metric"),)))
    ledger.bootstrap()
    value = lambda: ledger.merged().first()["Metric"]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = start_edit_stream(ledger, str(tmp_path / "cp"), quiet_ms=5000, poll="300 milliseconds")
    try:
        time.sleep(25)  # the first listing changes nothing
        assert ledger.audit().count() == 1 and value() == 1.0
        for v in (2, 3, 4):
            runs(v)
        deadline = time.time() + 120
        while value() != 4.0 and time.time() < deadline:
            time.sleep(0.5)
            assert q.exception() is None
        assert value() == 4.0
        time.sleep(8)
        assert ledger.audit().count() == 2
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

"""Stateful streams and the queue: replays equal tables, restarts neither lose nor repeat."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docketlake.streaming import messages, queue, stateful

NOW = datetime(2024, 1, 1)


def beats(seed, n=300):
    r = random.Random(seed)
    return [(f"m{i}", f"a{r.randrange(5)}", NOW + timedelta(seconds=r.randrange(0, 14_400), microseconds=r.randrange(1_000_000))) for i in range(n)]


def in_files(spark, rows, folder, parts, delay_s):
    """Rows as files in nearly the order of time: each file's rows are late by less than the delay."""
    rows = sorted(rows, key=lambda x: x[2])
    size = -(-len(rows) // parts)
    cut = [rows[k * size : (k + 1) * size] for k in range(parts)]
    for k, part in enumerate(cut):
        spark.createDataFrame(part, "id string, sender string, timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{folder}")
    return cut


def stream(spark, folder):
    return spark.readStream.schema("id string, sender string, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("parts", [1, 4])
def test_replay_of_beats_equals_the_table(spark, tmp_path, parts):
    rows = beats(parts)
    in_files(spark, rows, str(tmp_path / "in"), parts, 600)
    stateful.written(stateful.liveness(stream(spark, str(tmp_path / "in")), delay="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    got = sorted((r["key"], r["status"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    last = max(r[2] for r in rows)
    until = last.replace(microsecond=last.microsecond // 1000 * 1000) - timedelta(minutes=10)
    table = spark.createDataFrame(rows, "id string, sender string, timestamp timestamp")
    want = sorted((r["key"], r["status"], r["at"]) for r in stateful.transitions(table, "sender", "timestamp", F.lit(until)).collect())
    assert got == want and {s for _, s, _ in want} == {"idle", "offline"}
    plain = []
    for agent in {r[1] for r in rows}:
        at = sorted(r[2] for r in rows if r[1] == agent and r[2] <= until)
        for k, x in enumerate(at):
            if k == 0 or x - at[k - 1] > timedelta(minutes=5):
                plain.append((agent, "idle", x))
            if (at[k + 1] if k + 1 < len(at) else until) - x > timedelta(minutes=5):
                plain.append((agent, "offline", x + timedelta(minutes=5)))
    assert want == sorted(plain)


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    rows = sorted(beats(9), key=lambda x: x[2])
    run = lambda: stateful.written(stateful.liveness(stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, "id string, sender string, timestamp timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    last = max(r[2] for r in rows)
    until = last.replace(microsecond=last.microsecond // 1000 * 1000) - timedelta(minutes=10)
    want = stateful.transitions(spark.createDataFrame(rows, "id string, sender string, timestamp timestamp"), "sender", "timestamp", F.lit(until))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def plain_batches(rows, until, size, age):
    out = []
    for key in {r[1] for r in rows}:
        held = None
        for i, at in sorted(((r[0], r[2]) for r in rows if r[1] == key and r[2] <= until), key=lambda x: (x[1], x[0])):
            if held and at - held[0] >= age:
                out.append((key, held[0], held[0] + age, "age", held[1]))
                held = None
            held = (held[0], [*held[1], i]) if held else (at, [i])
            if len(held[1]) == size:
                out.append((key, held[0], at, "size", held[1]))
                held = None
        if held and until - held[0] >= age:
            out.append((key, held[0], held[0] + age, "age", held[1]))
    return sorted(out)


def test_batches_by_size_and_age(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"m{i}", f"k{r.randrange(3)}", NOW + timedelta(milliseconds=r.randrange(90_000))) for i in range(200)]
    in_files(spark, rows, str(tmp_path / "in"), 3, 10)
    stateful.written(stateful.batches(stream(spark, str(tmp_path / "in")), "sender", size=5), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    got = sorted((x["key"], x["opened"], x["closed"], x["reason"], x["ids"]) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    until = max(x[2] for x in rows) - timedelta(seconds=10)
    assert got == plain_batches(rows, until, 5, timedelta(seconds=5)) and {g[3] for g in got} == {"size", "age"}


def some(spark, a, b):
    return spark.createDataFrame([(f"m{i}", "job_created", "s", "q", f'{{"i": {i}}}', "c", NOW + timedelta(seconds=i), 60) for i in range(a, b)], messages.SCHEMA)


def test_queue_survives_a_kill(spark, tmp_path):
    path, out, cp = str(tmp_path / "queue"), str(tmp_path / "out"), str(tmp_path / "cp")
    assert [queue.publish(some(spark, k * 10, k * 10 + 10).repartition(2), path) for k in range(5)] == [1, 2, 3, 4, 5]
    assert queue.size(spark, path) == 50 and queue.pop(spark, path).count() == 50
    killed = []

    def sink(df, number):
        if number == 2 and not killed:
            killed.append(number)
            raise RuntimeError("killed")
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    start = lambda: queue.consume(spark, path, 1).writeStream.foreachBatch(sink).option("checkpointLocation", cp).start()
    first = start()
    with pytest.raises(Exception, match="killed"):
        first.processAllAvailable()
    assert 0 < queue.size(spark, path) < 50
    again = start()
    again.processAllAvailable()
    queue.publish(some(spark, 50, 53), path)
    again.processAllAvailable()
    again.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == sorted(f"m{i}" for i in range(53))
    assert queue.clear(spark, path) + queue.size(spark, path) <= 10


def test_every_callback_gets_every_batch(spark, tmp_path):
    path = str(tmp_path / "queue")
    queue.publish(some(spark, 0, 4), path)
    seen = []

    def bad(df, number):
        raise ValueError("no")

    query = queue.listen(queue.consume(spark, path), [bad, lambda df, n: seen.append(df.count()), lambda df, n: seen.append(df.agg(F.max("id")).first()[0])], str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert seen == [4, "m3"] and len(query.callback_errors) == 1
    assert queue.pop(spark, str(tmp_path / "none")).count() == 0 == queue.size(spark, str(tmp_path / "none"))


def test_publishers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "queue")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: queue.publish(some(spark, k, k + 1), path), range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6] and sorted(r["id"] for r in queue.pop(spark, path).collect()) == [f"m{i}" for i in range(6)]

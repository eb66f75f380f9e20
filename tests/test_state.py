"""Streams of login attempts, tokens and audit rows, and the files that leave and come back."""

import datetime as dt
import json
import random
import time

import pytest
from isobath.operators import reports as P
from isobath.plans import registry
from isobath.sources import readers as S
from isobath.streaming import state as Z
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def attempts(seed=1, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", None]), START + dt.timedelta(seconds=rng.randrange(0, 4000)), i) for i in range(n)]


def brute(rows, count, window):
    out, state = {}, {}
    for client, ts, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        start, used = state.get(client, (None, 0))
        if start is None or (ts - start).total_seconds() >= window:
            start, used = ts, 0
        state[client] = (start, used + 1)
        out[i] = 200 if used < count else 429
    return out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_limits_equal_brute_force(spark, batch):
    rows = attempts()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.id: r.status for r in Z.limit_logins(spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long").repartition(5), 5, 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, 5, 60) and set(got.values()) == {200, 429}


def run(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def in_files(spark, path, rows, shape, size):
    """A stream that takes size rows a batch, in their order."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], shape).coalesce(1).write.mode("append").parquet(str(path / f"n{i:06}"))
        time.sleep(0.02)  # files are taken by age
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


@pytest.mark.parametrize("size", [300, 60])
def test_stream_of_logins_equals_the_batch(spark, tmp_path, size):
    """Also in batches that split windows: by the attempts' own times, however long the stream pauses."""
    Z.timed(spark)
    rows = sorted(attempts(2, 300), key=lambda r: (r[1], r[2]))
    source = in_files(spark, tmp_path, rows, "client string, ts timestamp_ntz, id long", size)
    got = {r.id: r.status for r in run(spark, Z.stream_logins(source, 5, 60), f"logins{size}")}
    assert got == brute(rows, 5, 60) == {r.id: r.status for r in Z.limit_logins(spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long"), 5, 60).collect()}


def held_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_of_logins_goes_when_its_window_has_passed(spark, tmp_path):
    Z.timed(spark)
    rows = [(f"c{i}", START + dt.timedelta(seconds=i % 30), i) for i in range(200)] + [("late", START + dt.timedelta(hours=5), 900), ("last", START + dt.timedelta(hours=9), 901)]
    source = in_files(spark, tmp_path, rows, "client string, ts timestamp_ntz, id long", 100)
    query = Z.stream_logins(source, 5, 60).writeStream.format("memory").queryName("passing").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    held = held_rows(query)
    assert max(held) >= 100 and held[-1] <= 3  # of 202 clients, the last one's window and timer


def test_stream_of_revocations_equals_the_batch(spark, tmp_path):
    Z.timed(spark)
    tokens = registry.table(spark, SF, "tokens")
    rows = [tuple(r) for r in tokens.orderBy("ts", "id").collect()]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)
    source = in_files(spark, tmp_path, rows, shape, 350)
    query = Z.stream_revoked(source).writeStream.format("memory").queryName("revocations").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {r.id: r.revoked for r in spark.table("revocations").collect()}
    assert got == {r.id: r.revoked for r in Z.revoked(tokens).collect()} and any(got.values())
    # only tokens with a revocation that still holds are state, not each token ever seen
    assert held_rows(query)[-1] < len({r[3] for r in rows})


def test_login_chain_is_killed_and_started_again(spark, tmp_path):
    Z.timed(spark)
    users = registry.table(spark, SF, "users")
    rng = random.Random(8)
    rows = sorted([(rng.choice(["10.0.0.1, 172.16.0.9", "10.0.0.2", None]), START + dt.timedelta(seconds=rng.randrange(0, 4000)), i, rng.randrange(0, 200)) for i in range(240)], key=lambda r: (r[1], r[2]))
    shape = "client string, ts timestamp_ntz, id long, user_id long"
    batch = Z.login_chain(spark.createDataFrame(rows, shape), users, 5, 60)
    want = {r.id: r.answer for r in batch.collect()}
    assert set(want.values()) == {200, 401, 403, 429}
    source = in_files(spark, tmp_path / "in", rows, shape, 80)
    sink = Z.LoginSink(str(tmp_path / "out"), users)

    class Dies(Z.LoginSink):
        """Stops after the second batch has been written, before it counts as done."""

        def __call__(self, batch, number):
            super().__call__(batch, number)
            if number == 1:
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        Z.stream_login_chain(source, 5, 60, Dies(str(tmp_path / "out"), users), str(tmp_path / "check")).awaitTermination(120)
    for _ in range(2):  # started again, and once more with nothing new
        Z.stream_login_chain(source, 5, 60, sink, str(tmp_path / "check")).awaitTermination(120)
    audit = sink.audit(spark).collect()
    assert sorted(r.id for r in audit) == sorted(i for i, a in want.items() if a == 200)
    assert {r.address for r in audit} == {"10.0.0.1", "10.0.0.2", None}
    last = {r.user_id: (r.last_login.replace(tzinfo=None), r.logins) for r in sink.last_logins(spark).collect()}
    assert last == {r.user_id: (r.last_login, r.logins) for r in Z.last_logins(batch).collect()}


def test_audit_hours_and_first_uses_of_a_stream(spark, tmp_path):
    audit = registry.table(spark, SF, "audit_log")
    audit.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(audit.schema).parquet(str(tmp_path / "in"))
    got = {(r.hour, r.action): r.n for r in run(spark, Z.hourly(source), "hours", "complete")}
    assert got == {(r.hour, r.action): r.n for r in registry.QUERIES["audit_hours"](spark, SF).collect()}
    uses = source.select(F.col("user_id").alias("token"), F.col("event_time").alias("ts"))
    firsts = run(spark, Z.first_uses(uses, "3650 days"), "firsts")
    assert sorted(r.token for r in firsts) == sorted(r[0] for r in audit.select("user_id").distinct().collect())


def test_lines_come_back(spark, tmp_path):
    slim = spark.createDataFrame([(i, f"n{i}", None if i % 2 else 1.5) for i in range(600)], "id long, name string, lon double")
    lines = P.stream_lines(slim, F.lit("tag"), [0.0, 1.0, 2.0, 3.0], [F.col("id")])
    lines.orderBy("part").select("line").coalesce(1).write.text(str(tmp_path / "lines"))
    written = [x for f in (tmp_path / "lines").glob("*.txt") for x in f.read_text().splitlines()]
    assert json.loads(written[0]) == {"type": "manifest", "etag": "tag", "count": 600, "bbox": [0.0, 1.0, 2.0, 3.0]}
    (tmp_path / "lines" / "more.txt").write_text("\n{broken\n\n")
    back = S.read_ndjson(spark, str(tmp_path / "lines"), "id long, name string, lon double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, slim.collect()), key=lambda r: r[0])
    # in batches, as a consumer takes them
    seen = []
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "lines"))
    stream.writeStream.foreachBatch(lambda df, i: seen.append(df.filter(F.get_json_object("value", "$.id").isNotNull()).count())).trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen) == 600


def test_csv_and_geojson_files(spark, tmp_path):
    rows = [(1, 'a "b", c', None), (2, "x\ny", 3)]
    df = spark.createDataFrame(rows, "id long, text string, n int").coalesce(1)
    df.select(P.csv_line(F.col("id"), F.col("text"), F.col("n")).alias("l")).write.text(str(tmp_path / "csv"))
    back = spark.read.option("multiLine", True).option("escape", '"').schema("id long, text string, n int").csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == rows
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2.5], [-3, 4e0]]}, "properties": {"k": 1}}, {"type": "Feature", "geometry": None, "properties": {}}]}))
    (found,) = S.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert (found.geometry_type, found.xmin, found.ymin, found.xmax, found.ymax, json.loads(found.properties)) == ("LineString", -3.0, 2.5, 1.0, 4.0, {"k": 1})


def test_scenes_are_kept_under_their_key(spark, tmp_path):
    pixels = registry.table(spark, SF, "pixels").select(F.concat(F.lit("s2_"), F.col("scene_id").cast("string")).alias("cache_key"), "r", "c", "red")
    pixels.write.partitionBy("cache_key").parquet(str(tmp_path / "scenes"))
    one = spark.read.parquet(str(tmp_path / "scenes")).filter("cache_key = 's2_3'")
    assert one.count() == 1024 and "PartitionFilters: [isnotnull(cache_key" in one._jdf.queryExecution().toString()

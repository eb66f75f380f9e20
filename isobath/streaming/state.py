"""Keyed state over event streams and tables: login limits, revoked tokens, audit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def _judge(seconds: np.ndarray, start: float, used: int, count: int, window: float) -> tuple[np.ndarray, float, int]:
    """(status of each attempt in order, start and attempts of the last window); a window begins with its first attempt."""
    out = np.empty(len(seconds), np.int32)
    for i, s in enumerate(seconds.tolist()):
        if s >= start + window:
            start, used = s, 0
        used += 1
        out[i] = 200 if used <= count else 429
    return out, start, used


def limit_logins(attempts: DataFrame, count: int, window: int) -> DataFrame:
    """attempts (client, ts, id) with their status: 429 beyond count in a window of seconds that begins with its first attempt.

    Attempts are sorted by client and time inside partitions by client, and state is
    carried from batch to batch, so a busy client needs no more memory than others.
    A null client is a client; ties go by id.
    """
    dealt = attempts.select("client", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "id").repartition("client").sortWithinPartitions("client", "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, used = object(), float("-inf"), 0
        for batch in batches:
            clients, at = batch["client"].to_pylist(), np.asarray(batch["at"]) / 1e6
            status = np.empty(len(clients), np.int32)
            i = 0
            while i < len(clients):
                j = i
                while j < len(clients) and clients[j] == clients[i]:
                    j += 1
                if clients[i] != last:
                    last, start, used = clients[i], float("-inf"), 0
                status[i:j], start, used = _judge(at[i:j], start, used, count, window)
                i = j
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(status)], ["id", "status"])

    return dealt.mapInArrow(run, f"id {dealt.schema['id'].dataType.simpleString()}, status int")


def timed(spark: SparkSession) -> None:
    """Let the session's later streams keep state with timers, which needs the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _seconds(ts: pd.Series) -> np.ndarray:
    """Seconds since 1970 of a timestamp column of any unit."""
    return ts.astype("int64").to_numpy() / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1}[np.datetime_data(ts.dt.tz_localize(None).dtype)[0]]


def _objects(values: list) -> pd.Series:
    """A column of plain values: strings that pandas packs itself are refused on the way back."""
    return pd.Series(values, dtype=object)


class _LoginWindow(StatefulProcessor):
    """A client's window: when it began and how many attempts it saw; a timer in event time ends it."""

    def __init__(self, count: int, window: int):
        self.count, self.window = count, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "start double, used int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(rows).sort_values(["ts", "id"])
        start, used = self.held.get() if self.held.exists() else (float("-inf"), 0)
        before = start
        status, start, used = _judge(_seconds(own["ts"]), start, used, self.count, self.window)
        self.held.update((float(start), int(used)))
        if start != before:
            if before > float("-inf"):
                self.handle.deleteTimer(self._end(before))
            # one that has passed already would never be called
            self.handle.registerTimer(max(self._end(start), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"client": _objects([key[0]] * len(own)), "id": own["id"].to_numpy(), "status": status})

    def _end(self, start: float) -> int:
        return int((start + self.window) * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def _marked(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_logins(attempts: DataFrame, count: int, window: int, late: str = "0 seconds") -> DataFrame:
    """limit_logins for a stream of (client, ts, id), by the attempts' own times.

    A client's window is state until the watermark, ``late`` behind the latest
    attempt seen, has passed its end: a replay or an outage gives the same statuses,
    and clients that stay away leave nothing behind.  Attempts of a batch are taken
    in the order of their times; one that arrives in a later batch with an earlier
    time counts for the window that is open then, and one older than the watermark
    is dropped.  The session needs timed().
    """
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema}
    shape = f"client {kinds['client']}, id {kinds['id']}, status int"
    return _marked(attempts, late).groupBy("client").transformWithStateInPandas(_LoginWindow(count, window), shape, "Append", "EventTime")


def revoked(tokens: DataFrame) -> DataFrame:
    """(id, revoked) of each row of tokens (id, ts, kind, token, ttl): whether an earlier revocation of the token still holds; of equal times the smaller id is earlier."""
    before = Window.partitionBy("token").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.when(F.col("kind") == "revoke", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("ttl") * 1_000_000)
    held = F.unix_micros(F.col("ts").cast("timestamp")) < F.max(until).over(before)
    return tokens.select("id", F.coalesce(held, F.lit(False)).alias("revoked"))


class _Revocation(StatefulProcessor):
    """A token's latest end of revocation, which a timer in event time forgets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "until double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(rows).sort_values(["ts", "id"])
        before = until = self.held.get()[0] if self.held.exists() else float("-inf")
        out = []
        for s, kind, ttl in zip(_seconds(own["ts"]).tolist(), own["kind"], own["ttl"]):
            out.append(s < until)
            if kind == "revoke":
                until = max(until, s + ttl)
        now = timerValues.getCurrentWatermarkInMs()
        if until != before and until * 1000 > now:
            if before > float("-inf"):
                self.handle.deleteTimer(int(before * 1000))
            self.held.update((float(until),))
            self.handle.registerTimer(int(until * 1000))
        yield pd.DataFrame({"id": own["id"].to_numpy(), "revoked": out})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_revoked(tokens: DataFrame, late: str = "0 seconds") -> DataFrame:
    """revoked for a stream, by the rows' own times.

    Only tokens with a revocation that the watermark has not passed are state.
    Order, late rows and the session's needs are as for stream_logins().
    """
    return _marked(tokens, late).groupBy("token").transformWithStateInPandas(_Revocation(), "id long, revoked boolean", "Append", "EventTime")


def hourly(audit: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, action, n) of audit rows; for a stream, late says how long a window waits for late rows."""
    if late:
        audit = audit.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    counted = audit.groupBy(F.window("event_time", "1 hour"), "action").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), "action", "n")


def first_uses(uses: DataFrame, late: str) -> DataFrame:
    """The first use of each refresh token of a stream; a later use within the watermark is a reuse and is refused."""
    return uses.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["token"])


def login_answers(judged: DataFrame, users: DataFrame) -> DataFrame:
    """judged (client, ts, id, user_id, status) with the answer of a login: 429 over the limit, 401 for an unknown user, 403 for one who is not active, otherwise 200."""
    known = users.select(F.col("id").alias("user_id"), "username", "is_active", F.lit(True).alias("known"))
    over = F.col("status") == 429
    answer = F.when(over, 429).when(F.col("known").isNull(), 401).when(~F.col("is_active"), 403).otherwise(200)
    return judged.join(known, "user_id", "left").select("id", "client", "ts", "user_id", "username", answer.alias("answer"))


def login_chain(attempts: DataFrame, users: DataFrame, count: int, window: int) -> DataFrame:
    """login_answers() of attempts (client, ts, id, user_id) in batch form."""
    return login_answers(attempts.join(limit_logins(attempts, count, window), "id"), users)


def last_logins(answers: DataFrame) -> DataFrame:
    """(user_id, last_login, logins) of the logins that were let in."""
    return answers.filter("answer = 200").groupBy("user_id").agg(F.max("ts").alias("last_login"), F.count("*").alias("logins"))


class LoginSink:
    """Takes the answers of a stream, batch by batch, and keeps an audit row and a last login for each login let in.

    A batch is written under its number and replaces what an earlier try of it left,
    so a repeated batch adds nothing.  audit() and last_logins() read all batches.
    """

    def __init__(self, path: str, users: DataFrame):
        self.path, self.users = path.rstrip("/"), users

    def __call__(self, batch: DataFrame, number: int) -> None:
        answers = login_answers(batch, self.users).persist()  # the state behind batch must move once
        try:
            entries = answers.filter("answer = 200").select("id", "user_id", "username", F.lit("login").alias("action"), F.trim(F.split("client", ",")[0]).alias("address"), "ts")
            entries.write.mode("overwrite").parquet(f"{self.path}/audit/batch={number}")
            last_logins(answers).write.mode("overwrite").parquet(f"{self.path}/logins/batch={number}")
        finally:
            answers.unpersist()

    def audit(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/audit").drop("batch")

    def last_logins(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/logins").groupBy("user_id").agg(F.max("last_login").alias("last_login"), F.sum("logins").alias("logins"))


def stream_login_chain(attempts: DataFrame, count: int, window: int, sink: LoginSink, checkpoint: str, late: str = "0 seconds"):
    """Start the chain over a stream of (client, ts, id, user_id): rate check, verification, last login and audit row; what is there now is taken and the stream ends.

    The limit's state keeps a client's attempts apart from what follows, which is
    done for each batch by the sink.
    """
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema}
    shape = f"client {kinds['client']}, id {kinds['id']}, ts timestamp, user_id {kinds['user_id']}, status int"
    judged = _marked(attempts, late).groupBy("client").transformWithStateInPandas(_LoginChain(count, window), shape, "Append", "EventTime")
    return judged.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _LoginChain(_LoginWindow):
    """The login window that hands on what the rest of the chain needs."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(rows).sort_values(["ts", "id"])
        (judged,) = super().handleInputRows(key, iter([own]), timerValues)
        users = _objects([None if pd.isna(u) else int(u) for u in own["user_id"]])
        yield pd.DataFrame({"client": judged["client"], "id": judged["id"], "ts": own["ts"].reset_index(drop=True), "user_id": users, "status": judged["status"]})

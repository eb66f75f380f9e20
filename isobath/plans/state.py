"""Queries of keyed state in batch form: login limits, revoked tokens, refresh rotation, sessions, audit counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isobath.plans.base import query
from isobath.streaming import state as Z


@query("login_limits")
def _(t):
    # the anchor of a window is its first event, which SQL without recursion cannot follow
    return Z.limit_logins(t("events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id")), 5, 3600)


@query(
    "revoked_tokens",
    """SELECT id, coalesce(ts < max(CASE WHEN kind = 'revoke' THEN ts + CAST(ttl AS INT) * INTERVAL 1 SECOND END) OVER (PARTITION BY token ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS revoked FROM tokens""",
    ("tokens",),
)
def _(t):
    return Z.revoked(t("tokens"))


@query("refresh_rotation", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts, event_id) = 1 THEN 200 ELSE 401 END AS status FROM events")
def _(t):
    uses = t("events").select("event_id", F.concat_ws(":", "user_id", (F.col("event_id") % 40)).alias("token"), "ts")
    # the first use of a refresh token revokes it
    first = F.row_number().over(Window.partitionBy("token").orderBy("ts", "event_id"))
    return uses.select("event_id", F.when(first == 1, 200).otherwise(401).alias("status"))


@query("logouts", "SELECT id, CASE WHEN ttl - 1800 > 0 THEN ttl - 1800 ELSE 3600 END AS access_seconds, CASE WHEN ttl - 7200 > 0 THEN ttl - 7200 ELSE 86400 END AS refresh_seconds FROM tokens", ("tokens",))
def _(t):
    def left(used: int, least: int):
        return F.when(F.col("ttl") - used > 0, F.col("ttl") - used).otherwise(least)

    return t("tokens").select("id", left(1800, 3600).alias("access_seconds"), left(7200, 86400).alias("refresh_seconds"))


@query("last_logins", "SELECT u.id, max(e.ts) AS last_login, count(e.event_id) AS logins FROM users u LEFT JOIN events e ON e.user_id = u.id AND e.event_type = 'click' AND u.is_active GROUP BY u.id", ("users",))
def _(t):
    logins = t("events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    ok = F.col("is_active") & F.col("ts").isNotNull()
    return t("users").join(logins, "id", "left").select("id", F.when(ok, F.col("ts")).alias("last_login"), F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("logins"))


@query("audit_hours", "SELECT date_trunc('hour', event_time) AS hour, action, count(*) AS n FROM audit_log GROUP BY 1, 2", ("audit_log",))
def _(t):
    return Z.hourly(t("audit_log")).select("hour", "action", "n")


@query("login_answers")
def _(t):
    # as login_limits; users are the ones the attempts name, every eleventh of them unknown
    attempts = t("events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 > 0, F.col("user_id")).alias("user_id"))
    return Z.login_chain(attempts, t("users"), 5, 3600)

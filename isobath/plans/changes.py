"""Queries of changes to the catalogue: inserts, edits, shares, deletes, settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobath.operators import changes as H
from isobath.operators import tables as T
from isobath.plans.base import query

NOW = "2026-01-01 00:00:00"

@query("insert_rasters", "SELECT id, name, processing_status, source_kind FROM raster_catalog UNION ALL SELECT id + 10000000, name, 'pending', CASE WHEN id % 2 = 0 THEN 'derived' ELSE 'source' END FROM vector_datasets", ("raster_catalog", "vector_datasets"))
def _(t):
    new = t("vector_datasets").select((F.col("id") + 10_000_000).alias("id"), "name", F.when(F.col("id") % 2 == 0, "derived").alias("source_kind"))
    return H.insert(t("raster_catalog").select("id", "name", "processing_status", "source_kind"), new, processing_status=F.lit("pending"), source_kind=F.lit("source"))


@query("insert_missing_members", "SELECT group_id, user_id FROM user_group_members UNION ALL SELECT n.group_id, n.user_id FROM (SELECT DISTINCT CAST(5 AS INT) AS group_id, id AS user_id FROM users) n WHERE NOT EXISTS (SELECT 1 FROM user_group_members m WHERE m.group_id = n.group_id AND m.user_id = n.user_id)", ("user_group_members", "users"))
def _(t):
    old = t("user_group_members").select("group_id", "user_id")
    new = t("users").select(F.lit(5).cast(old.schema["group_id"].dataType).alias("group_id"), F.col("id").alias("user_id"))
    return T.insert_new(old, new, ["group_id", "user_id"])


@query("report_centres", "SELECT r.id, (c.xmin + c.xmax) / 2 AS lon, (c.ymin + c.ymax) / 2 AS lat FROM reports r LEFT JOIN raster_catalog c ON c.id = r.depth_raster_id", ("reports", "raster_catalog"))
def _(t):
    centre = t("raster_catalog").select(F.col("id").alias("depth_raster_id"), ((F.col("xmin") + F.col("xmax")) / 2).alias("lon"), ((F.col("ymin") + F.col("ymax")) / 2).alias("lat"))
    return t("reports").select("id", "depth_raster_id").join(centre, "depth_raster_id", "left").select("id", "lon", "lat")


@query("delete_set_null", "SELECT c.id, CASE WHEN u.is_active THEN c.uploaded_by END AS uploaded_by FROM raster_catalog c LEFT JOIN users u ON u.id = c.uploaded_by", ("raster_catalog", "users"))
def _(t):
    return T.delete_set_null(t("raster_catalog").select("id", "uploaded_by"), t("users").filter("NOT is_active").select("id"), "uploaded_by")


@query("default_map_state", "SELECT s.id, s.user_id, CASE WHEN c.id IS NULL THEN s.is_default ELSE s.id = c.id END AS is_default FROM map_states s LEFT JOIN (SELECT user_id, max(id) AS id FROM map_states WHERE user_id % 2 = 0 GROUP BY user_id) c USING (user_id)", ("map_states",))
def _(t):
    states = t("map_states").select("id", "user_id", "is_default")
    return T.exclusive_default(states, "user_id", "id", states.filter("user_id % 2 = 0").groupBy("user_id").agg(F.max("id").alias("id"))).select("id", "user_id", "is_default")


@query("touched_rasters", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM raster_catalog", ("raster_catalog",))
def _(t):
    rasters = t("raster_catalog").select("id", "name", "updated_at")
    return H.touch(rasters, rasters.filter("id % 3 = 0").select("id", F.lit("renamed").alias("name")), "id", F.lit(NOW).cast("timestamp_ntz"))


@query("broadcast_list", "SELECT id, CASE WHEN id % 3 = 0 THEN '1,2,3' WHEN id % 3 = 1 THEN '2,3' ELSE '1,3' END AS items FROM user_groups", ("user_groups",))
def _(t):
    def item(i: int):
        return F.struct(F.lit(i).alias("id"), F.lit(f"note {i}").alias("text"))

    added = T.append_item(F.array(item(1), item(2)), item(3))
    left = T.remove_item(added, (F.col("id") % 3).cast("int"))
    return t("user_groups").select("id", F.array_join(F.transform(left, lambda x: x["id"].cast("string")), ",").alias("items"))


@query("metadata_merge", "SELECT id, '1' AS a, CASE WHEN id % 2 = 0 THEN '9' ELSE '2' END AS b, CASE WHEN id % 2 = 0 THEN '3' END AS c FROM raster_catalog", ("raster_catalog",))
def _(t):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>"))
    return t("raster_catalog").select("id", T.merge_maps(old, new).alias("m")).select("id", *[F.element_at("m", k).alias(k) for k in "abc"])


@query("cache_put", "SELECT k, last_seen FROM (SELECT user_id AS k, ts AS last_seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(t):
    # every put of a key replaces the one before it
    puts = t("events").select(F.col("user_id").alias("k"), F.col("ts").alias("last_seen"), "event_id")
    return T.upsert(puts.limit(0), puts, ["k"], F.struct("last_seen", "event_id")).select("k", "last_seen")


@query("cache_expired", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def _(t):
    last = t("events").agg(F.max("ts").alias("now"))  # one row
    return t("events").join(F.broadcast(last), F.col("ts") < F.col("now") - F.expr("INTERVAL 10 DAY")).select("event_id")


@query(
    "series_inserts",
    """SELECT e.event_id, CASE WHEN x.timeseries_id IS NOT NULL OR e.n > 1 THEN 409 ELSE 201 END AS status FROM (SELECT event_id, user_id AS timeseries_id, event_id % 500 AS raster_id, row_number() OVER (PARTITION BY user_id, event_id % 500 ORDER BY event_id) AS n FROM events) e
    LEFT JOIN (SELECT DISTINCT timeseries_id, raster_id FROM raster_timeseries_entries) x ON x.timeseries_id = e.timeseries_id AND x.raster_id = e.raster_id""",
    ("raster_timeseries_entries",),
)
def _(t):
    new = t("events").select("event_id", F.col("user_id").alias("timeseries_id"), (F.col("event_id") % 500).alias("raster_id"))
    return H.insert_checked(t("raster_timeseries_entries"), new, ["timeseries_id", "raster_id"], [F.col("event_id")]).select("event_id", "status")


@query("series_delete", "SELECT timeseries_id, raster_id FROM raster_timeseries_entries WHERE timeseries_id % 7 <> 0", ("raster_timeseries_entries",))
def _(t):
    return T.delete_cascade(t("raster_timeseries"), t("raster_timeseries_entries"), F.col("id") % 7 == 0, "id", "timeseries_id")[1].select("timeseries_id", "raster_id")


@query(
    "layer_requests",
    """SELECT r.id, r.action, CASE WHEN d.id IS NULL THEN 404 WHEN d.created_by = r.user_id OR (r.action <> 'rename' AND u.role = 'admin') OR (r.action = 'add' AND EXISTS (SELECT 1 FROM user_group_members m WHERE m.user_id = r.user_id AND m.group_id IN (d.shared_group, (d.shared_group + 3) % 25))) THEN 200 ELSE 403 END AS status
    FROM layer_changes r LEFT JOIN vector_datasets d ON d.id = r.layer_id LEFT JOIN users u ON u.id = r.user_id""",
    ("layer_changes", "vector_datasets", "users", "user_group_members"),
)
def _(t):
    layers = t("vector_datasets").withColumn("shared_with", F.array("shared_group", (F.col("shared_group") + 3) % 25))
    return H.layer_rights(t("layer_changes"), t("users"), t("user_group_members"), layers)


@query("layer_share", "SELECT id, CASE WHEN id % 2 = 0 THEN '1,2' ELSE CAST(shared_group AS VARCHAR) END AS groups FROM vector_datasets", ("vector_datasets",))
def _(t):
    # sharing writes the whole list anew
    old = t("vector_datasets").select("id", F.array(F.col("shared_group").cast("string")).alias("groups"))
    return T.update_where(old, F.col("id") % 2 == 0, groups=F.array(F.lit("1"), F.lit("2"))).select("id", F.array_join("groups", ",").alias("groups"))


@query("replace_group_apps", "SELECT group_id, app_name FROM group_allowed_apps WHERE group_id % 5 <> 0 UNION ALL SELECT DISTINCT g.group_id, r.app_name FROM group_allowed_apps g, registered_apps r WHERE g.group_id % 5 = 0 AND r.app_name IN ('app_1', 'app_2')", ("group_allowed_apps", "registered_apps"))
def _(t):
    old = t("group_allowed_apps").select("group_id", "app_name")
    new = old.filter("group_id % 5 = 0").select("group_id", F.explode(F.array(F.lit("app_1"), F.lit("app_2"), F.lit("app_2"))).alias("app_name"))
    return H.replace_set(old, new, "group_id")


@query(
    "member_and_area_requests",
    """SELECT e.event_id, CASE WHEN e.level NOT IN ('view', 'download', 'manage') THEN 400 WHEN m.user_id IS NOT NULL OR e.n > 1 THEN 409 ELSE 201 END AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, group_id, level IN ('view', 'download', 'manage') ORDER BY event_id) AS n FROM (
        SELECT event_id, user_id, CAST(event_id % 25 AS INT) AS group_id, CASE event_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'download' WHEN 2 THEN 'manage' ELSE 'own' END AS level FROM events)) e
    LEFT JOIN (SELECT DISTINCT group_id, user_id FROM user_group_members) m ON m.user_id = e.user_id AND m.group_id = e.group_id""",
    ("user_group_members",),
)
def _(t):
    level = F.when(F.col("event_id") % 4 == 0, "view").when(F.col("event_id") % 4 == 1, "download").when(F.col("event_id") % 4 == 2, "manage").otherwise("own")
    new = t("events").select("event_id", "user_id", (F.col("event_id") % 25).cast("int").alias("group_id"), level.alias("level"))
    return H.insert_checked(t("user_group_members"), new, ["user_id", "group_id"], [F.col("event_id")], F.col("level").isin("view", "download", "manage")).select("event_id", "status")


@query("user_deactivation", "SELECT id, is_active AND NOT (id % 4 = 0 AND id % 8 <> 0) AS is_active FROM users", ("users",))
def _(t):
    # actor 8k may not deactivate itself, the others of every fourth user go
    asked = t("users").filter("id % 4 = 0").select(F.when(F.col("id") % 8 == 0, F.col("id")).otherwise(F.lit(1)).cast("long").alias("actor_id"), F.col("id").alias("user_id"))
    return H.soft_delete(t("users"), asked)[0].select("id", "is_active")


@query("user_names", "SELECT c_custkey AS id, CASE WHEN row_number() OVER (PARTITION BY left(c_name, 14) ORDER BY c_custkey) > 1 OR EXISTS (SELECT 1 FROM users u WHERE u.username = left(c_name, 14)) THEN 409 ELSE 201 END AS status FROM customer", ("users",))
def _(t):
    new = t("customer").select(F.col("c_custkey").alias("id"), F.left("c_name", F.lit(14)).alias("username"))
    return H.insert_checked(t("users"), new, ["username"], [F.col("id")]).select("id", "status")


@query("project_view", "SELECT id, CASE WHEN id % 2 = 0 THEN '7,8,9' ELSE CAST(id AS VARCHAR) END AS rasters FROM map_states", ("map_states",))
def _(t):
    saved = t("map_states").select("id", F.array(F.col("id").cast("string")).alias("rasters"))
    return T.update_where(saved, F.col("id") % 2 == 0, rasters=F.array(*map(F.lit, "789"))).select("id", F.array_join("rasters", ",").alias("rasters"))


@query("map_state_names", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY user_id, name ORDER BY id) > 1 THEN 409 ELSE 201 END AS status FROM map_states", ("map_states",))
def _(t):
    states = t("map_states").select("id", "user_id", "name")
    return H.insert_checked(states.limit(0), states, ["user_id", "name"], [F.col("id")]).select("id", "status")


@query("own_map_states", "SELECT id, name FROM map_states WHERE user_id = 16 ORDER BY updated_at DESC, id", ("map_states",))
def _(t):
    return t("map_states").filter("user_id = 16").orderBy(F.desc("updated_at"), "id").select("id", "name")


@query("removed_objects", "SELECT id, b AS bucket, id || '.' || e AS key FROM raster_catalog, (VALUES ('raw', 'raw'), ('jph', 'jph'), ('thumbnails', 'png')) v(b, e) WHERE processing_status = 'failed'", ("raster_catalog",))
def _(t):
    return H.removed_objects(t("raster_catalog").filter("processing_status = 'failed'"))


@query("settings_some", "SELECT key, value FROM settings WHERE key IN ('NATION_1', 'NATION_2', 'nothing')", ("settings",))
def _(t):
    return t("settings").filter(F.col("key").isin("NATION_1", "NATION_2", "nothing")).select("key", "value")


@query("settings_all", "SELECT key, value FROM settings ORDER BY key", ("settings",))
def _(t):
    return t("settings").orderBy("key").select("key", "value")


@query("settings_upsert", "SELECT key, CASE WHEN key < 'NATION_2' THEN 'new' ELSE value END AS value FROM settings UNION ALL SELECT 'ZZ', 'new'", ("settings",))
def _(t):
    old = t("settings").select("key", "value")
    new = old.filter("key < 'NATION_2'").select("key").union(old.limit(1).select(F.lit("ZZ"))).withColumn("value", F.lit("new"))
    return T.upsert(old, new, ["key"])


@query("job_last_state", "SELECT id, state FROM (SELECT user_id AS id, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END DESC, event_id) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase')) WHERE n = 1")
def _(t):
    changes = t("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("state"), "ts", "event_id")
    found = H.latest_state(changes, "id", [F.desc("ts")], {"view": 0, "click": 1, "purchase": 2})
    return found.select("id", "state")


@query(
    "raster_state_changes",
    "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') || '>' || event_type IN ('>view', 'view>click', 'click>purchase', 'click>view') AS legal FROM events",
)
def _(t):
    changes = t("events").withColumn("state", F.col("event_type"))
    return H.may_follow(changes, "user_id", [F.col("ts"), F.col("event_id")], {"": ["view"], "view": ["click"], "click": ["purchase", "view"]}).select("event_id", "legal")


@query("audit_append", "SELECT id, action, client FROM (SELECT id, action, '' AS client FROM audit_log UNION ALL SELECT id + 100000000, 'login', CASE WHEN forwarded <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE coalesce(peer, 'unknown') END FROM requests WHERE id % 10 = 0)", ("audit_log", "requests"))
def _(t):
    from isobath.functions.keys import first_hop

    old = t("audit_log").select("id", "action", F.lit("").alias("client"))
    new = t("requests").filter("id % 10 = 0").select((F.col("id") + 100_000_000).alias("id"), F.lit("login").alias("action"), first_hop(F.col("forwarded"), F.col("peer")).alias("client"))
    return H.insert(old, new)

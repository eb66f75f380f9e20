"""Checked changes to tables: what an insert, edit, share or delete request leads to, for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CREATED, OK, BAD, FORBIDDEN, MISSING, CONFLICT = 201, 200, 400, 403, 404, 409


def insert(old: DataFrame, new: DataFrame, **defaults: Column) -> DataFrame:
    """old with the rows of new; columns that new lacks, and nulls in those that have a default, take the default."""
    given = [F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults and c in new.columns else F.col(c) if c in new.columns else defaults.get(c, F.lit(None)).alias(c) for c in old.columns]
    return old.unionByName(new.select(*given))


def insert_checked(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], valid: Column | None = None) -> DataFrame:
    """new with its status: bad where it is not valid, conflict where old or an earlier row of new has its keys, else created."""
    held = old.select(*keys).distinct().withColumn("__held", F.lit(True))
    valid = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    first = F.row_number().over(Window.partitionBy(*keys, valid).orderBy(*order))
    marked = new.withColumn("__n", first).join(held, keys, "left")
    status = F.when(~valid, BAD).when(F.col("__held") | (F.col("__n") > 1), CONFLICT).otherwise(CREATED)
    return marked.withColumn("status", status).drop("__n", "__held")


def touch(df: DataFrame, changes: DataFrame, key: str, now: Column, stamp: str = "updated_at") -> DataFrame:
    """df with the values of changes (key and some columns) where they are given, and the time of change in rows that changed."""
    columns = [c for c in changes.columns if c != key]
    joined = df.alias("d").join(changes.alias("n"), F.col(f"d.{key}") == F.col(f"n.{key}"), "left")
    changed = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == stamp:
            return F.when(changed, now).otherwise(F.col(f"d.{c}")).alias(c)
        return F.coalesce(F.col(f"n.{c}"), F.col(f"d.{c}")).alias(c) if c in columns else F.col(f"d.{c}")

    return joined.select(*[value(c) for c in df.columns])


def replace_set(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """old with the rows of each owner that new names replaced by new's rows, without repeats."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new.distinct())


def layer_rights(requests: DataFrame, users: DataFrame, members: DataFrame, layers: DataFrame) -> DataFrame:
    """requests (id, user_id, layer_id, action) with their status.

    Adding is open to the owner, administrators and members of a group that the layer
    is shared with; editing and deleting to the owner and administrators; renaming
    to the owner alone.
    """
    layer = layers.select(F.col("id").alias("layer_id"), "created_by", "shared_with")
    who = users.select(F.col("id").alias("user_id"), "role")
    groups = members.groupBy("user_id").agg(F.collect_set("group_id").alias("groups"))  # a user is in a few groups
    df = requests.join(layer, "layer_id", "left").join(who, "user_id", "left").join(groups, "user_id", "left")
    own, admin = F.col("created_by") == F.col("user_id"), F.col("role") == "admin"
    shared = F.coalesce(F.arrays_overlap("shared_with", "groups"), F.lit(False))
    may = F.when(F.col("action") == "add", own | admin | shared).when(F.col("action").isin("update", "delete"), own | admin).when(F.col("action") == "rename", own)
    status = F.when(F.col("created_by").isNull(), MISSING).when(F.coalesce(may, F.lit(False)), OK).otherwise(FORBIDDEN)
    return df.select("id", "action", status.alias("status"))


def soft_delete(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users with the named ones inactive, requests (actor_id, user_id) with their status); nobody deactivates themselves."""
    known = users.select(F.col("id").alias("user_id")).withColumn("__known", F.lit(True))
    status = F.when(F.col("actor_id") == F.col("user_id"), BAD).when(F.col("__known").isNull(), MISSING).otherwise(OK)
    judged = requests.join(known, "user_id", "left").withColumn("status", status).drop("__known")
    gone = judged.filter(F.col("status") == OK).select(F.col("user_id").alias("__gone")).distinct()
    left = users.join(gone, F.col("id") == F.col("__gone"), "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone")
    return left, judged


#: Objects that go with a raster; the tiled copy is left behind. Fixed values.
OBJECTS = {"raw": "raw", "jph": "jph", "thumbnails": "png"}


def removed_objects(rasters: DataFrame) -> DataFrame:
    """(id, bucket, key) of the objects that are removed with each raster."""
    kinds = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(e).alias("ext")) for b, e in OBJECTS.items()])
    return rasters.select("id", F.explode(kinds).alias("o")).select("id", "o.bucket", F.concat(F.col("id").cast("string"), F.lit("."), F.col("o.ext")).alias("key"))


def latest_state(events: DataFrame, key: str, order: list[Column], ranks: dict[str, int]) -> DataFrame:
    """The last state of each key; among changes of one time the one furthest along counts, unknown states are left out."""
    rank = F.element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), F.col("state"))
    known = events.withColumn("__rank", rank).filter("__rank IS NOT NULL")
    newest = Window.partitionBy(key).orderBy(*order, F.desc("__rank"))
    return known.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__rank")


def may_follow(events: DataFrame, key: str, order: list[Column], allowed: dict[str, list[str]]) -> DataFrame:
    """events with whether each change of state follows the one before it; a key's first state must be allowed after null."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy(key).orderBy(*order)), F.lit(""))
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return events.withColumn("legal", F.concat(before, F.lit(">"), F.col("state")).isin(pairs))

"""Scope, joins, dedup, windows and rewrites: functions from frames to frames.

Every "first wins" has an order that names its tie-break. Frames that are joined keep their keys; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """df worked out once, however often it is read: as a checkpoint where spark.checkpoint.dir is set, else in the cache."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to four tasks a core or more, whatever its files are: rows of few bytes and much work would lie in one task."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


# Scope and filters

def in_scope(rows: DataFrame, links: DataFrame, org, workspace) -> DataFrame:
    """rows: id, is_global, org, ws; links: id, link_ws. Global rows, and the organisation's that belong to the workspace, are
    linked to it, or belong to none and are linked to none. A row that several links let in comes once."""
    joined = rows.join(links, "id", "left")
    own = (F.col("ws") == workspace) | (F.col("link_ws") == workspace) | (F.col("ws").isNull() & F.col("link_ws").isNull())
    return joined.filter(F.col("is_global") | ((F.col("org") == org) & own)).select(*rows.columns).distinct()


def in_global_workspaces(rows: DataFrame, links: DataFrame, workspaces: DataFrame, kind) -> DataFrame:
    """Rows that are linked to any global workspace of the kind."""
    chosen = links.join(workspaces.filter(F.col("is_global") & (F.col("type") == kind)).select(F.col("ws").alias("link_ws")), "link_ws", "left_semi")
    return rows.join(chosen.select("id"), "id", "left_semi")


def may_read(is_global: Column, owner: Column, org: Column, user, own_org) -> Column:
    return F.when(is_global, True).when(owner.isNotNull(), owner == user).otherwise(F.coalesce(org == own_org, F.lit(False)))


def searched(term: str, *columns: Column) -> Column:
    """Case-insensitive substring in any of the columns; nulls do not match."""
    low = term.strip().lower()
    found = F.lit(not low)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return found


# Dedup

def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_value_first_place(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """A map's semantics: of rows with one key the last value stays, at the place of the first."""
    rest = [c for c in df.columns if c not in (key, ordinal)]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_v"), F.min(ordinal).alias(ordinal))
    return out.select(key, ordinal, "_v.*")


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_and_margin(df: DataFrame, keys: Sequence[str], score: str, *ties: Column) -> DataFrame:
    """The best row of each key, with runner_up: the next best score (null without one)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("runner_up", F.lead(score).over(w)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def archived_beyond(df: DataFrame, keys: Sequence[str], keep: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") > keep).drop("_n")


def filled_sections(df: DataFrame, keys: Sequence[str], position: str, is_heading: str) -> DataFrame:
    """section: how many headings a row has above it or is (0 before the first)."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("section", F.sum(F.col(is_heading).cast("int")).over(w))


def labelled(df: DataFrame, keys: Sequence[str], position: str, text: str) -> DataFrame:
    """A lone label such as (a) goes before the row that follows; of two in a row the second wins, the last is lost."""
    lone = F.trim(F.col(text)).rlike(r"^[(]?[a-z0-9]{1,3}[)]$")
    w = Window.partitionBy(*keys).orderBy(position)
    out = df.withColumn("_lone", lone).withColumn("_before", F.when(F.lag("_lone").over(w), F.trim(F.lag(text).over(w))))
    return out.filter("not _lone").withColumn(text, F.when(F.col("_before").isNotNull(), F.concat_ws(" ", "_before", text)).otherwise(F.col(text))).drop("_lone", "_before")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


# Rewrites of whole tables: plain files have no updates

def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of new replace those of old with the same keys, but for the columns to keep; the rest of both stay."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("_a")), new.select(*keys, F.struct(*rest).alias("_b"))
    both = a.join(b, list(keys), "full")
    value = lambda c: F.when(F.col("_b").isNull() | (F.lit(c in keep) & F.col("_a").isNotNull()), F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}")).alias(c)
    return both.select(*keys, *[value(c) for c in rest])


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old, list(keys), "left_anti"))


def purged(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone, list(keys), "left_anti")


def new_versions(versions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """versions: key, version, text; changes: key, text. The rows to append: each change under the next number."""
    last = versions.groupBy(key).agg(F.max("version").alias("_last"))
    return changes.join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).alias("version"), "text")


def copied(rows: DataFrame, versions: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows and their versions under ids of their own, made from the old id and the target; the current version follows."""
    fresh = lambda c: F.sha2(F.concat_ws(":", F.lit(target), F.col(c).cast("string")), 256)
    v = versions.withColumns({"version_id": fresh("version_id"), "id": fresh("id")})
    return rows.withColumns({"id": fresh("id"), "current_version_id": fresh("current_version_id")}), v

"""Manifests (rel_path, mtime, size, deleted): differences, overlays, tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE_S, RETENTION_S = 2.0, 30 * 86400


def diff(local: DataFrame, remote: DataFrame, mode: str = "both", path: str = "rel_path", mtime: str = "mtime", deleted: str = "deleted") -> DataFrame:
    """(path, action): pull or delete, for the paths that need one."""
    side = lambda df, n: df.select(F.col(path), F.col(mtime).alias(f"{n}_m"), F.coalesce(F.col(deleted), F.lit(False)).alias(f"{n}_d"), F.lit(True).alias(n))
    rows = side(local, "l").join(side(remote, "r"), path, "full_outer")
    have = lambda n: F.coalesce(F.col(n), F.lit(False))
    live = lambda n: have(n) & ~F.coalesce(F.col(f"{n}_d"), F.lit(False))
    newer = F.col("r_m") - F.col("l_m")
    if mode == "slave":
        action = F.when(~live("r") & live("l"), "delete").when(live("r") & (~live("l") | (F.abs(newer) > TOLERANCE_S)), "pull")
    else:
        action = F.when(~have("r"), None).when(~have("l"), F.when(live("r"), "pull")).when(newer > TOLERANCE_S, F.when(F.col("r_d"), F.when(live("l"), "delete")).otherwise("pull")).when(F.col("l_d") & live("r") & (newer > 0), "pull")
    return rows.select(path, action.alias("action")).where("action IS NOT NULL")


def guard(plan: DataFrame, remote: DataFrame, deleted: str = "deleted") -> DataFrame:
    """Without a live remote record no delete is carried out. The test is one row, broadcast."""
    live = remote.agg(F.coalesce(F.bool_or(~F.coalesce(F.col(deleted), F.lit(False))), F.lit(False)).alias("__live"))
    return plan.crossJoin(F.broadcast(live)).where((F.col("action") != "delete") | F.col("__live")).drop("__live")


def overlay(base: DataFrame, over: DataFrame, path: str = "rel_path") -> DataFrame:
    """Rows of ``over`` replace those of base."""
    return base.join(over.select(path), path, "left_anti").unionByName(over)


def prune(tombstones: DataFrame, now: float, mtime: str = "mtime") -> DataFrame:
    return tombstones.where(F.col(mtime) > now - RETENTION_S)

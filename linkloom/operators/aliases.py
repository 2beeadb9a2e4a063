"""Entities, alias indexes, profiles and upserts of a knowledge base snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: entity_ord is the order of the snapshot; results depend on it only in ties.
ENTITY_COLUMNS = ("entity_id", "standard_name", "aliases", "entity_type", "description", "entity_ord")


def alias_index(entities: DataFrame) -> DataFrame:
    """alias, alias_ord, entity_id, entity_ord: each name of each entity once, stripped; blank ones and entities without
    id or name are left out. alias_ord is the place at which the snapshot first shows the alias."""
    named = entities.where((F.coalesce("entity_id", F.lit("")) != "") & (F.coalesce("standard_name", F.lit("")) != ""))
    names = F.concat(F.array("standard_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = named.select("entity_id", "entity_ord", F.posexplode(names).alias("at", "raw")).withColumn("alias", tx.strip_spaces(F.col("raw"))).where("alias <> ''")
    rows = rows.groupBy("alias", "entity_id").agg(F.min(F.struct("entity_ord", "at")).alias("p")).select("alias", "entity_id", F.col("p.entity_ord").alias("entity_ord"), F.col("p.at").alias("at"))
    first = rows.groupBy("alias").agg(F.min(F.struct("entity_ord", "at")).alias("alias_ord"))
    return rows.join(first, "alias").select("alias", "alias_ord", "entity_id", "entity_ord", "at")


def last_owner(index: DataFrame) -> DataFrame:
    """alias, entity_id: the entity that named an alias last."""
    return index.groupBy("alias").agg(F.max_by("entity_id", F.struct("entity_ord", "at")).alias("entity_id"))


def first_owner(index: DataFrame) -> DataFrame:
    return index.groupBy("alias").agg(F.min_by("entity_id", F.struct("entity_ord", "at")).alias("entity_id"))


def alias_conflicts(index: DataFrame) -> DataFrame:
    """alias, owners: aliases of more than one entity."""
    return index.groupBy("alias").agg(F.countDistinct("entity_id").alias("owners")).where("owners > 1")


def type_profile(entities: DataFrame, weak_below: int = 8) -> DataFrame:
    """For each type: entities, mean aliases, missing descriptions and aliases, and whether it is weak."""
    n = F.size(F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.groupBy("entity_type").agg(
        F.count("*").alias("entities"),
        F.sum(n).cast("long").alias("alias_total"),
        F.count_if(F.coalesce("description", F.lit("")) == "").alias("missing_description"),
        F.count_if(n == 0).alias("missing_aliases"),
    ).withColumn("weak", F.col("entities") < weak_below)


def duplicates(entities: DataFrame, key: str) -> DataFrame:
    return entities.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def upsert(base: DataFrame, more: DataFrame, added_aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The base with new entities and alias updates (entity_id, aliases), and the issues met.

    An id that exists already is an error and is not added; an alias that another entity owns is a warning and is
    added all the same; an update for an unknown id is an error.
    """
    fresh = more.join(base.select("entity_id"), "entity_id", "left_anti")
    again = more.join(base.select("entity_id"), "entity_id", "left_semi").select(F.lit("error").alias("severity"), F.lit("duplicate_entity_id").alias("issue"), F.col("entity_id"), F.lit(None).cast("string").alias("alias"))
    merged = base.unionByName(fresh)
    issues = again
    if added_aliases is not None:
        unknown = added_aliases.join(merged.select("entity_id"), "entity_id", "left_anti").select(F.lit("error"), F.lit("unknown_entity_id"), "entity_id", F.lit(None).cast("string"))
        new = added_aliases.groupBy("entity_id").agg(F.flatten(F.collect_list("aliases")).alias("_more"))
        merged = merged.join(new, "entity_id", "left").withColumn("aliases", F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")
        issues = issues.union(unknown)
    owner = first_owner(alias_index(base)).withColumnRenamed("entity_id", "_owner")
    taken = alias_index(merged).join(owner, "alias").where("entity_id <> _owner").join(alias_index(base).select("alias", "entity_id"), ["alias", "entity_id"], "left_anti")
    return merged, issues.union(taken.select(F.lit("warning"), F.lit("alias_owned_elsewhere"), "entity_id", "alias"))


def balanced_sample(rows: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """n rows, one of each group in turn."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)

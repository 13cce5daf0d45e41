"""Differences of manifests: maps by key, member sets, single fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPES = {"dependencies": "runtime", "optional_dependencies": "optional", "peer_dependencies": "peer", "dev_dependencies": "development"}


def sides(packages: DataFrame) -> DataFrame:
    """One row for each pair with a struct of each side."""
    columns = [c for c in packages.columns if c not in ("pair_id", "side")]
    pick = lambda s: F.first(F.when(F.col("side") == s, F.struct(*columns)), ignorenulls=True).alias(s)
    return packages.groupBy("pair_id").agg(pick("before"), pick("after"))


def map_changes(pairs: DataFrame, field: str) -> DataFrame:
    """pair_id, name, before, after and change of each key whose value differs; no join, as both maps lie in one row."""
    empty = F.create_map().cast("map<string,string>")
    b, a = F.coalesce(F.col(f"before.{field}"), empty), F.coalesce(F.col(f"after.{field}"), empty)
    keys = pairs.select("pair_id", b.alias("b"), a.alias("a")).withColumn("name", F.explode(F.array_union(F.map_keys("b"), F.map_keys("a"))))
    got = keys.select("pair_id", "name", F.try_element_at("b", F.col("name")).alias("before"), F.try_element_at("a", F.col("name")).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return got.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def dependency_changes(pairs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [map_changes(pairs, field).withColumn("scope", F.lit(scope)) for field, scope in SCOPES.items()])


def script_changes(pairs: DataFrame) -> DataFrame:
    return map_changes(pairs, "scripts")


def maintainer_changes(pairs: DataFrame) -> DataFrame:
    """added and removed members; the source's own list wins over the manifest's where it has one."""

    def members(side: str):
        own = F.col(f"{side}.source_maintainers")
        chosen = F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(F.coalesce(F.col(f"{side}.maintainers"), F.array().cast("array<string>")))
        return F.array_sort(F.array_distinct(chosen))

    got = pairs.select("pair_id", members("before").alias("b"), members("after").alias("a"))
    return got.select("pair_id", F.array_except("a", "b").alias("added"), F.array_except("b", "a").alias("removed")).filter((F.size("added") > 0) | (F.size("removed") > 0))


def field_changes(pairs: DataFrame) -> DataFrame:
    value = lambda s: [("name", F.col(f"{s}.name")), ("license", F.col(f"{s}.license")), ("repository", F.col(f"{s}.repository")), ("node engine", F.try_element_at(F.col(f"{s}.engines"), F.lit("node")))]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), b.alias("before"), a.alias("after")) for (f, b), (_, a) in zip(value("before"), value("after"))])
    return pairs.select("pair_id", F.explode(rows).alias("x")).select("pair_id", "x.*").filter(~F.col("before").eqNullSafe(F.col("after")))

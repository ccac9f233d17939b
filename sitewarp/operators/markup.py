"""Structured data as rows: types, identity references and profiles, from the shredded JSON-LD columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarp.functions.urls import host


def last_key(path: Column) -> Column:
    """The last member name of a leaf path; indexes of arrays do not count."""
    return F.regexp_extract(F.regexp_replace(path, r"(/[0-9]+)+\z", ""), r"([^/]*)\z", 1)


def declared(leaves: DataFrame) -> DataFrame:
    """(page_id, type): distinct declared types per page, lower case, without their vocabulary's address."""
    return leaves.where(last_key(F.col("path")) == "@type").select("page_id", F.lower(F.regexp_extract("value", r"([^/#]*)\z", 1)).alias("type")).where("type <> ''").distinct()


def dangling_references(leaves: DataFrame) -> DataFrame:
    """(page_id, ref): objects that hold nothing but an ``@id`` which no fuller object of the page defines.

    An object with more than one leaf below it defines its id. Leaves are counted for every object above them: as many
    rows as the nesting is deep, never pairs of objects.
    """
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    sizes = leaves.select("page_id", F.explode(above).alias("object")).groupBy("page_id", "object").agg(F.count("*").alias("n"))
    ids = leaves.where("path like '%/@id'").select("page_id", F.regexp_replace("path", r"/@id\z", "").alias("object"), F.col("value").alias("ref"))
    sized = ids.join(sizes, ["page_id", "object"])
    return sized.where("n = 1").select("page_id", "ref").distinct().join(sized.where("n > 1").select("page_id", "ref").distinct(), ["page_id", "ref"], "left_anti")


def profile_hosts(leaves: DataFrame, page: DataFrame) -> DataFrame:
    """(site, n_hosts): distinct hosts that a site's pages name as the same entity elsewhere."""
    found = leaves.where("path rlike '/sameAs(/[0-9]+)?$'").select("page_id", host(F.col("value")).alias("h")).where("h <> ''")
    return found.join(page.select("page_id", "site").dropDuplicates(["page_id"]), "page_id").groupBy("site").agg(F.count_distinct("h").alias("n_hosts"))


def at_path(document: Column, dotted: str) -> Column:
    """The text at a dotted path of a JSON text, the first element wherever the path meets an array; null if it is absent or the
    text does not parse."""
    value = F.try_parse_json(document)
    step = None
    for name in dotted.split("."):
        here = F.try_variant_get(value, f"$['{name}']", "variant")
        value = F.coalesce(F.try_variant_get(here, "$[0]", "variant"), here)
        step = value
    return F.try_variant_get(step, "$", "string")

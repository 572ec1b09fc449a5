"""Concept trees (SKOS JSON) to ``(uri, name)``."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CONCEPT = "struct<id:string,prefLabel:map<string,string>,narrower:array<string>>"


def _name(concept: Column, language: str) -> Column:
    """The wanted language, else the first language that has a name."""
    labels = concept["prefLabel"]
    any_name = F.get(F.filter(F.map_values(labels), lambda v: F.trim(v) != ""), 0)
    return F.trim(F.coalesce(F.nullif(F.element_at(labels, F.lit(language)), F.lit("")), any_name))


def flatten_concepts(schemes: DataFrame, rank: str, scheme: str = "json", language: str = "de") -> DataFrame:
    """All concepts of the trees, one level per round until a level is empty (the trees are finite JSON texts).

    A URI in several schemes keeps the name of the scheme with the lowest ``rank``; inside one
    scheme the deepest, then last-sorted name stays.
    """
    top = F.from_json(F.col(scheme), "struct<hasTopConcept:array<string>>")["hasTopConcept"]
    level = schemes.select(rank, F.explode(top).alias("node"))
    levels = []
    for depth in count():
        concepts = cut_lineage(level.select(rank, F.from_json("node", CONCEPT).alias("c")))
        if concepts.isEmpty():
            break
        levels.append(concepts.select(rank, F.lit(depth).alias("depth"), F.col("c.id").alias("uri"),
                                      _name(F.col("c"), language).alias("name")))
        level = concepts.select(rank, F.explode("c.narrower").alias("node"))
    found = reduce(DataFrame.unionByName, levels).where("uri is not null and name <> ''")
    return found.groupBy("uri").agg(
        F.min_by("name", F.struct(F.col(rank), -F.col("depth"), F.col("name"))).alias("name"))

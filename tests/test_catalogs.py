"""Counts of the domain graph."""

import pytest

from pyspark.sql import functions as F

from stratagraph.operators import graph, kg
from stratagraph.sources import catalogs


@pytest.fixture(scope="module")
def facts(spark):
    return catalogs.base_facts(spark).cache(), catalogs.enriched_facts(spark).cache()


def test_fact_counts(facts):
    base, enriched = facts
    assert (base.count(), enriched.count()) == (1049, 1187)
    undated = lambda f: f.where("tb IS NULL AND te IS NULL").count()
    assert (undated(base), undated(enriched)) == (130, 268)
    assert enriched.where("r = 'peak_season'").count() == 15
    assert enriched.where("r = 'occupies_elevation'").count() == 34 + 14
    assert base.where("r = 'has_protection'").count() == 13


def test_vocabularies(facts):
    base, enriched = facts
    assert (kg.entity_ids(base).count(), kg.entity_ids(enriched).count()) == (66, 101)
    assert (kg.relation_ids(base).count(), kg.relation_ids(enriched).count()) == (20, 35)
    assert kg.relation_ids(enriched).where("id = 0").first().name == "at_elevation"


def test_quads_and_split(facts):
    base, enriched = (kg.expand_intervals(f, catalogs.N_YEARS) for f in facts)
    assert (base.count(), enriched.count()) == (2006, 3110)
    assert (base.distinct().count(), enriched.distinct().count()) == (1997, 3069)
    label = kg.split_label(F.col("tau"), 4, 5, 6)
    assert {r["s"]: r["count"] for r in enriched.withColumn("s", label).groupBy("s").count().collect()} == {"train": 1909, "valid": 384, "test": 817}
    assert {r["s"]: r["count"] for r in base.withColumn("s", label).groupBy("s").count().collect()} == {"train": 1219, "valid": 246, "test": 541}


def test_hierarchies(spark, facts):
    edges = catalogs.hierarchies(spark)
    assert {r["hierarchy"]: r["count"] for r in edges.groupBy("hierarchy").count().collect()} == {"spatial": 39, "taxonomic": 40, "trophic": 28}
    assert {r["hierarchy"]: r["count"] for r in graph.closure(edges).groupBy("hierarchy").count().collect()} == {"spatial": 145, "taxonomic": 91, "trophic": 111}
    names = edges.select(F.explode(F.array("parent", "child")).alias("name"))
    assert kg.extended_ids(kg.entity_ids(facts[1]), names).count() == 136

"""A component of any size is split as a small one of the same shape is."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import graph
from tallyforge.storage import Scratch

CLIQUES = 50_100


@pytest.mark.parametrize("method", ["leiden", "label_propagation"])
def test_a_component_of_many_nodes_is_split(spark, method):
    """Cliques of four nodes, each with a weak edge to the first: one component of 200,400 nodes."""
    pairs = spark.range(CLIQUES).selectExpr("id * 4 AS n").selectExpr("explode(array(array(n, n + 1), array(n, n + 2), array(n, n + 3), array(n + 1, n + 2), array(n + 1, n + 3), array(n + 2, n + 3), array(0L, n))) AS p")
    edges = pairs.selectExpr("p[0] AS a", "p[1] AS b", "if(p[0] = 0 and p[1] > 3, 0.01D, 1.0D) AS weight")
    parts = graph.communities(Scratch(spark, "large"), edges, "x", 2.0, method)
    found = parts.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    right = F.col("nodes") == F.expr("array(component, component + 1, component + 2, component + 3)")
    assert tuple(found.agg(F.count("*"), F.count_if(right & (F.col("component") % 4 == 0))).first()) == (CLIQUES, CLIQUES)

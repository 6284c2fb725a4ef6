"""All queries over the test tables, with their SQL."""

from __future__ import annotations

from granary.plans import cluster, explore, files, graph, itemsets, recommend, similarity, sketch

MODULES = [explore, files, itemsets, similarity, recommend, graph, sketch, cluster]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}

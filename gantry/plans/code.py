"""Queries over the texts of source files: facts of functions, findings, clones."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import code as C
from gantry.sources.tables import table


def _facts(spark, folder):
    return C.code_facts(table(spark, folder, "source_text"))


def function_facts(spark, folder):
    """A row per function of a Python file, with its measures."""
    return _facts(spark, folder).select("repository_id", "node_id", F.explode("functions").alias("f")).select("repository_id", "node_id", "f.*")


def class_facts(spark, folder):
    return _facts(spark, folder).select("repository_id", "node_id", F.explode("classes").alias("c")).select("repository_id", "node_id", "c.*")


def structural_findings(spark, folder):
    nodes = table(spark, folder, "graph_nodes").filter("node_type = 'file'")
    calls = table(spark, folder, "graph_edges").filter("edge_type = 'calls' and target_node_id is not null").select("repository_id", F.col("target_node_id").alias("callee"))
    return C.structural_findings(_facts(spark, folder), nodes, calls)


def performance_findings(spark, folder):
    return C.performance_findings(_facts(spark, folder))


def clone_spans(spark, folder):
    return C.clone_spans(table(spark, folder, "source_text"))


def duplication(spark, folder):
    files = table(spark, folder, "source_text")
    return C.duplication(C.clone_spans(files), files)


QUERIES = {"function_facts": function_facts, "class_facts": class_facts, "structural_findings": structural_findings, "performance_findings": performance_findings, "clone_spans": clone_spans, "duplication": duplication}

#: Syntax trees and token windows can't be said in SQL; tests compare them with fixtures and brute force.
SQL: dict[str, str] = {}

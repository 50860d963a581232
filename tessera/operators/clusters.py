"""Clusters: greedy complete linkage in input order, and merging a cluster to one row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def complete_link(vectors: DataFrame, group: str, key: str, vector: str, threshold: float) -> DataFrame:
    """(group, key, cluster): greedy complete-linkage clusters in key order, within each ``group``.

    The rule is sequential (a row joins the first open cluster all of whose members reach the threshold), but only rows that chains of
    such cosines connect can meet in a cluster, so each connected part of a group is one task and the rest never leave their
    blocks. Rows that nothing reaches, and unusable vectors, are clusters of their own. The cluster's name is its first key.
    """
    import numpy as np

    from tessera.operators.graph import connected_components
    from tessera.operators.vectors import linking_edges

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        x = np.array([np.asarray(v, np.float64) for v in pdf[vector]])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm == 0, 1, norm)
        names = [None] * len(pdf)
        for i in range(len(pdf)):
            if names[i] is None:
                names[i] = pdf[key][i]
                open_to = x @ x[i] >= threshold
                for j in range(i + 1, len(pdf)):
                    if names[j] is None and open_to[j]:
                        names[j] = pdf[key][i]
                        open_to &= x @ x[j] >= threshold
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": names})

    types = dict(vectors.dtypes)
    usable = vectors.where(F.col(vector).isNotNull()).select(group, key, vector)
    edges = linking_edges(usable.select(F.col(key).cast("long").alias("id"), F.col(group).alias("grp"), F.col(vector).alias("vector")), threshold)
    parts = connected_components(edges, "a", "b").select(F.col("node").alias(key), F.col("component").alias("_part"))
    placed = usable.join(parts, key, "left")
    schema = f"{group} {types[group]}, {key} {types[key]}, cluster {types[key]}"
    linked = placed.where("_part is not null").groupBy("_part").applyInPandas(lambda pdf: run(pdf.drop(columns="_part")), schema)
    return linked.unionByName(placed.where("_part is null").select(group, key, F.col(key).alias("cluster")))


def merge_clusters(rows: DataFrame, cluster: str) -> DataFrame:
    """One row a cluster: success-weighted confidence (at most .95), summed counters, first and last times, ordered distinct tags."""
    weight = F.col("success_count") + 1
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags"))))
    return rows.groupBy(cluster).agg(
        F.count("*").alias("members"),
        F.least(F.lit(0.95), F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"),
        F.sum("success_count").alias("success_count"),
        F.sum("access_count").alias("access_count"),
        F.min("created_at").alias("created_at"),
        F.max("last_accessed").alias("last_accessed"),
        F.array_join(tags, ",").alias("tags"),
    )


def due(entries: int, at_last: int) -> bool:
    """Whether consolidation runs by itself: from 30 entries on, after every ten new ones."""
    return entries >= 30 and entries - at_last >= 10


def consolidate(rows: DataFrame, key: str, vector: str, threshold: float = 0.85, most: int = 2000, least: int = 10) -> DataFrame:
    """``merge_clusters`` of the connected groups of cosine ``threshold`` among the ``most`` best rows by confidence (the bound is the feature); fewer than ``least`` rows stay as they are.

    The result names each cluster by its smallest key; rows that nothing reaches are clusters of their own.
    """
    from tessera.operators.graph import connected_components
    from tessera.operators.vectors import linking_edges

    best = rows.orderBy(F.col("confidence").desc(), key).limit(most)
    if best.limit(least).count() < least:
        return merge_clusters(best.withColumn("cluster", F.col(key)), "cluster")
    edges = linking_edges(best.select(F.col(key).cast("long").alias("id"), F.lit(0).alias("grp"), F.col(vector).alias("vector")), threshold)
    labels = connected_components(edges, "a", "b").withColumnsRenamed({"node": key, "component": "cluster"})
    return merge_clusters(best.join(labels, key, "left").withColumn("cluster", F.coalesce("cluster", F.col(key))), "cluster")

"""Vectors that probe many lists are stored once and read by those that probe them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from particlelake.llm import pq_neighbors


def test_probes_move_no_vectors(spark):
    """Vectors without clusters probe nearly all lists; each probe took a whole vector through a shuffle before."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[300:330] = x[:30] + rng.normal(size=(30, 8)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, vector array<double>").withColumn("weight", F.col("rep") % 3 + 1)
    blocks = pq_neighbors.linked_blocks(df, 0.95, 600, 40, 16)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert not [step for step in ("Repartition", "FlatMapGroups", "Generate", "Join") if step in plan]
    units = x / np.linalg.norm(x, axis=1)[:, None]
    near = units @ units.T >= 0.95
    np.fill_diagonal(near, False)
    wanted = near @ (np.arange(600) % 3 + 1)
    found = {r["id"]: r["links"] for r in blocks.groupBy("id").agg(F.sum("links").alias("links")).collect()}
    assert found == {i: n for i, n in enumerate(wanted.tolist()) if n} and len(found) >= 60
    assert all(near[r["id"]].any() and r["root"] <= r["id"] for r in blocks.collect())

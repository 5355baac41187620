"""Distributed union-find: connected components of an edge table.

Each round first unites the edges that lie in one partition, which needs no shuffle and leaves
each node at most one parent per task; deals the remaining (node, parent) rows by node and
unites again; then replaces each parent by its own parent. A node that very many edges touch
therefore never brings its edges into one task: it is a parent in most rows, and rows are dealt
by child. The join of the last step may meet a hot parent; both its sides are plain shuffles, so
adaptive execution can split it. Every round is written to the shared folder.

A round's first uniting has a task for every `AT_ONCE` rows, however many files hold them, so few
rows meet in few tasks; where one task has them all, its result is the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.session import lean, materialize, ship_package

MAX_ROUNDS = 60
#: Rows that one task unites first; 16 bytes each.
AT_ONCE = 100_000


def min_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the smallest node that each is connected with."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _unite(batches):
    """Edges of one partition in, (node, smallest node) rows out."""
    held: list[np.ndarray] = []
    size = 0

    def united():
        edges = np.concatenate(held, axis=1)
        nodes, roots = min_labels(edges[0], edges[1])
        keep = nodes != roots
        return np.stack([nodes[keep], roots[keep]])

    for b in batches:
        if b.num_rows:
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            size += b.num_rows
        if size > 4_000_000:  # shrink before going on: at most one row a node stays
            held = [united()]
            size = held[0].shape[1] // 2
    if held:
        node, parent = united()
        for i in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(parent[i : i + 100_000])], ["node", "parent"])


def components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that an edge touches, except each component's smallest, with that smallest node.

    `edges` is a written table, as it is read more than once; an earlier result is a set of edges
    too. Edges with a null end or with two equal ends are ignored; an empty table gives an empty one.
    """
    ship_package(spark)
    schema = "node long, parent long"
    rows = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("parent")).filter("node <> parent")
    n = rows.count()
    for k in range(MAX_ROUNDS):
        tasks = max(1, -(-n // AT_ONCE))
        own = rows.coalesce(tasks).mapInArrow(lean(_unite), schema)
        if tasks == 1:
            return materialize(spark, own.select("node", F.col("parent").alias("component")), "cc")
        united = materialize(spark, own.repartition("node").mapInArrow(lean(_unite), schema), f"cc{k}")
        up = united.groupBy(F.col("node").alias("parent")).agg(F.min("parent").alias("above"))
        jumped = materialize(spark, united.join(materialize(spark, up, f"up{k}"), "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().cast("long").alias("moved")), f"jump{k}")
        moved, n, distinct = jumped.agg(F.coalesce(F.sum("moved"), F.lit(0)), F.count("*"), F.count_distinct("node")).first()
        rows = jumped.select("node", "parent")
        if not moved and n == distinct:
            return rows.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

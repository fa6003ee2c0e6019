"""Connected components of a table of links, by alternating large and small stars.

Each round is two joins and two aggregates; the number of rounds grows with the logarithm of a component's size. Links
that are few enough for one task meet there instead: the rounds' shuffles would cost more than the work. Links and labels
never leave the executors; the driver sees one row of counts a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpointed, let_go

#: Links that one task takes: some 60 MB there.
FEW = 1 << 19


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang on to the least neighbour: neighbours above a node (large), or those below it and the node (small)."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a, b and the least node of each one's component, without those that are it themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[i] != root[j])):
        x, y = root[i[apart]], root[j[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def _in_one_task(batches):
    got = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), ())))
    node, root = rooted(a, b)
    del got, a, b
    let_go()
    for k in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_pydict({"node": node[k : k + (1 << 16)], "root": root[k : k + (1 << 16)]})


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of links (a, b long) with the least node of its component; roots are left out."""
    links, before = checkpointed(links.where("a <> b").select("a", "b").distinct()), None
    if links.count() <= FEW:
        return checkpointed(links.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    while True:
        links = checkpointed(_star(_star(links, True), False))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state

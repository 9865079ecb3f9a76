"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Forest:
    """Union-find over arbitrary integers; a tree's root is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def contracted(batches):
    """Replace the edges that a task holds by stars of the same components."""
    forest, nodes = Forest(), set()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(u, v)
            nodes.update((u, v))
    pairs = [(x, r) for x in nodes if (r := forest.root(x)) != x]
    columns = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_EDGES)


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: every node hands its larger (large star) or smaller (small star) neighbours its smallest one."""
    sides = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-least")
    found = sides.join(least, "u")
    if small:
        return found.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
    return found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _settled(stars: DataFrame) -> DataFrame:
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(edges: DataFrame, *, rounds: int = 50, few: int = 200_000) -> DataFrame:
    """(u, v) bigint -> (node, component): the smallest node reachable, for every node of an edge. Self-loops and
    repeated edges do not matter; an empty table gives an empty one. Every task first contracts its edges; where no more
    than `few` are left (3 MB), one more task contracts those, else stars alternate until they settle."""
    edges = edges.select("u", "v").mapInArrow(tidy(contracted), "u bigint, v bigint")
    stars = written(edges.where("u > v").distinct(), "stars")
    if stars.count() <= few:
        return _settled(written(stars.coalesce(1).mapInArrow(tidy(contracted), "u bigint, v bigint"), "stars"))
    state = None
    for _ in range(rounds):
        stars = written(_star(_star(stars, small=False), small=True), "stars")
        now = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == state:
            return _settled(stars)
        state = now
    raise RuntimeError("components did not settle")

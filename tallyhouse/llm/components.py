"""Connected components by contraction, for tables of links of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Scratch


def _pointed(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node -> to: each node that has a smaller neighbour points at the smallest, then at what that points at, and so on for four steps."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to"))
    both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    first = scratch.write(both.groupBy("node").agg(F.min("to").alias("to")).where("to < node"), "pointers", links=True)
    p = first
    for _ in range(2):
        q = p.select(F.col("node").alias("to"), F.col("to").alias("next"))
        p = p.join(q, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    out = scratch.write(p, "roots", links=True)
    scratch.drop(first)
    return out


def merged(scratch: Scratch, components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (id, comp) after the links (a, b) between ids are added; comp stays the smallest id in it.

    Each round maps links to components, points every component at a smaller neighbour and contracts; a round at least
    halves the components that still have links. Ids without links keep what they have.
    """
    a, b = (components.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    left = links.join(a, "a").join(b, "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).where("a <> b").distinct()
    left = scratch.write(left, "links", links=True)
    while not left.isEmpty():
        p = _pointed(scratch, left)
        to_a, to_b, to_c = (p.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in ("a", "b", "comp"))
        moved = components.join(to_c, "comp", "left").select("id", F.coalesce("to_comp", "comp").alias("comp"))
        moved = scratch.write(moved, "components", links=True)
        new = left.join(to_a, "a", "left").join(to_b, "b", "left")
        new = new.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a <> b").distinct()
        new = scratch.write(new, "links", links=True)
        scratch.drop(p, left, components)
        components, left = moved, new
    scratch.drop(left)
    return components

"""Layers and strong components of a directed graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import kept


def layers(edges: DataFrame) -> DataFrame:
    """node, layer: the longest path to each node of a graph without cycles. edges: src, dst.

    In each round the edges stay whose beginning is still led to, so a round
    works on what is left, and a node's layer is the number of rounds in which
    edges lead to it. There are as many rounds as layers. Where a round takes no
    edge away, the graph has a cycle, which is an error (see
    ``strong_components``). Edges without an end are passed over.
    """
    left = kept(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    told = left.select(F.col("src").alias("node")).union(left.select("dst")).withColumn("layer", F.lit(0))
    count, layer = left.count(), 0
    while count:
        layer += 1
        told = told.unionByName(left.select(F.col("dst").alias("node"), F.lit(layer).alias("layer")))
        left = kept(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        before, count = count, left.count()
        if count == before:
            raise ValueError("the graph has a cycle")
    return told.groupBy("node").agg(F.max("layer").alias("layer"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: nodes that reach each other, named after the least of them. edges: src, dst.

    Nodes that no edge leads to, or none from, are components of their own and
    are trimmed. Of the others each takes the greatest colour (node) that
    reaches it; those that reach the node of their colour inside the colour are
    its component, which goes, and all starts again with the rest. Colours are
    disjoint, so a round finds a component in each. Edges without an end are
    passed over; a node with only a loop is a component of its own.
    """
    left = kept(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    nodes = kept(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    left = kept(left.where("src <> dst"))
    found: list[DataFrame] = []
    while True:
        left, alone = _trimmed(left), nodes
        nodes = kept(left.select(F.col("src").alias("node")).distinct())  # each of them leads and is led to
        found.append(alone.join(nodes, "node", "left_anti").withColumn("component", F.col("node")))
        if nodes.isEmpty():
            break
        colours = _spread(nodes.withColumn("colour", F.col("node")), left)
        ends = left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("from")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("to")), "dst")
        inner = kept(ends.where(F.col("from") == F.col("to")).select("src", "dst", F.col("to").alias("colour")))
        reached = new = colours.where("node = colour")
        while not new.isEmpty():  # backwards from the node of each colour
            new = new.select(F.col("node").alias("dst")).join(inner, "dst").select(F.col("src").alias("node"), "colour").distinct()
            new = kept(new.join(reached.select("node"), "node", "left_anti"))
            reached = reached.union(new)
        reached = kept(reached)
        found.append(reached.join(reached.groupBy("colour").agg(F.min("node").alias("component")), "colour").select("node", "component"))
        nodes = kept(nodes.join(reached.select("node"), "node", "left_anti"))
        left = _among(left, nodes)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return kept(inside.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _trimmed(left: DataFrame) -> DataFrame:
    """The edges that are left when those go, again and again, whose beginning nothing leads to or whose end leads nowhere."""
    count = left.count()
    while count:
        for _ in range(2):  # two steps in one job
            led = left.select(F.col("dst").alias("src")).distinct()
            leading = left.select(F.col("src").alias("dst")).distinct()
            left = left.join(led, "src", "left_semi").join(leading, "dst", "left_semi").select("src", "dst")
        left = kept(left)
        before, count = count, left.count()
        if count == before:
            break
    return left


def _spread(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """The greatest colour that reaches each node; only nodes that changed pass theirs on."""
    state = moved = kept(colours)
    while not moved.isEmpty():
        passed = moved.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.max("colour").alias("more"))
        both = kept(state.join(passed, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", "more").alias("colour"), (F.col("more") > F.col("colour")).alias("moved")))
        state, moved = both.select("node", "colour"), both.where("moved").select("node", "colour")
    return state


def component_layers(edges: DataFrame) -> DataFrame:
    """node, component, layer of a large graph that may have cycles: the longest path to a node's component in the graph of components."""
    edges = kept(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    own = kept(strong_components(edges))
    between = _ends(edges, own).where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    placed = layers(between).select(F.col("node").alias("component"), "layer")
    return own.join(placed, "component", "left").select("node", "component", F.coalesce("layer", F.lit(0)).alias("layer"))


def cyclic_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst, component: the edges that lie on a cycle, that is, inside a component (node, component), loops included."""
    return _ends(edges.select("src", "dst").distinct(), components).where("a = b").select("src", "dst", F.col("a").alias("component"))


def _ends(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst, and the components a and b of both."""
    a, b = (components.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("src", "a"), ("dst", "b")))
    return edges.join(a, "src").join(b, "dst")


def forward_edges(edges: list[tuple[str, str]]) -> tuple[list[str], list[tuple[str, str]]]:
    """Nodes by first appearance, and the edges that lead back to no node on the way to them.

    A walk in depth from each node in turn, along edges in their order; loops
    and edges to a node that the walk is still below are left out.
    """
    after: dict[str, dict[str, None]] = {}
    for a, b in edges:
        after.setdefault(a, {})
        after.setdefault(b, {})
        if a != b:
            after[a][b] = None
    seen, kept_edges = set(), []
    for root in after:
        if root in seen:
            continue
        seen.add(root)
        path = {root: iter(after[root])}  # the way down, each node with the edges it has left
        while path:
            node = next(reversed(path))
            target = next(path[node], None)
            if target is None:
                del path[node]
            elif target not in path:
                kept_edges.append((node, target))
                if target not in seen:
                    seen.add(target)
                    path[target] = iter(after[target])
    return list(after), kept_edges


def diagram_layers(edges: DataFrame, graph: str, order: str) -> DataFrame:
    """graph, node, layer of many small graphs, such as diagrams, that may have cycles. edges: graph, order, src, dst.

    A graph is one diagram and fits a task; ``layers`` is for a large one.
    Edges that close a cycle do not count (see ``forward_edges``), the longest
    path over the others is a node's layer. Edges without an end are passed over; edges of one place are in order of their ends.
    """

    @F.pandas_udf("array<struct<node:string,layer:int>>")
    def placed(graphs: pd.Series) -> pd.Series:
        return pd.Series([[{"node": n, "layer": k} for n, k in _longest([(e["src"], e["dst"]) for e in g]).items()] for g in graphs])

    whole = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy(graph).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "src", "dst"))).alias("edges"))
    return whole.select(graph, placed("edges").alias("nodes")).select(graph, F.inline("nodes"))


def _longest(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Each node's longest path over forward edges."""
    nodes, forward = forward_edges(edges)
    after: dict[str, list[str]] = {n: [] for n in nodes}
    waits = dict.fromkeys(nodes, 0)
    for a, b in forward:
        after[a].append(b)
        waits[b] += 1
    layer, ready = dict.fromkeys(nodes, 0), [n for n in nodes if not waits[n]]
    for n in ready:
        for b in after[n]:
            layer[b] = max(layer[b], layer[n] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return layer

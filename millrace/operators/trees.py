"""Syntax trees as arrays of nodes in pre-order.

A node is (pos, depth, parent, ast_type, tok_kind, tok, line_beg, line_end, subtree_end); nodes i to subtree_end - 1
are the subtree of node i. Trees come as nested JSON arrays: [type:kind, lines, token] or [type, lines, child...]."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.base import let

NODE = T.StructType(
    [
        T.StructField("pos", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("parent", T.IntegerType()),
        T.StructField("ast_type", T.StringType()), T.StructField("tok_kind", T.StringType()), T.StructField("tok", T.StringType()),
        T.StructField("line_beg", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("subtree_end", T.IntegerType()),
    ]
)
NODES = T.ArrayType(NODE)


def flatten_tree(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    nodes: list[dict] = []
    todo: list = [(json.loads(text), 0, -1)]
    while todo:
        item = todo.pop()
        if isinstance(item, int):
            nodes[item]["subtree_end"] = len(nodes)
            continue
        tree, depth, parent = item
        kind, lines, *rest = tree
        first, _, last = str(lines).partition("-")
        name, _, tok_kind = kind.partition(":")
        node = {"pos": len(nodes), "depth": depth, "parent": parent, "ast_type": name, "tok_kind": tok_kind or None, "tok": rest[0] if tok_kind else None, "line_beg": int(first), "line_end": int(last or first), "subtree_end": 0}
        nodes.append(node)
        todo.append(node["pos"])
        if not tok_kind:
            todo += [(child, depth + 1, node["pos"]) for child in reversed(rest)]
    return nodes


@F.pandas_udf(NODES)
def parse_tree(trees: pd.Series) -> pd.Series:
    return trees.map(flatten_tree)


def subtree(nodes: Column, pos: Column) -> Column:
    return F.slice(nodes, pos + 1, F.get(nodes, pos)["subtree_end"] - pos)


def tree_tokens(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["tok_kind"].isNotNull()), lambda n: n["tok"])


def tree_size(nodes: Column) -> Column:
    return F.size(nodes)


def tree_height(nodes: Column) -> Column:
    return F.array_max(F.transform(nodes, lambda n: n["depth"])) - F.get(nodes, 0)["depth"] + 1


def pre_order(nodes: Column) -> Column:
    return nodes


def breadth_first(nodes: Column) -> Column:
    return F.transform(F.array_sort(F.transform(nodes, lambda n: F.struct(n["depth"].alias("d"), n["pos"].alias("p"), n.alias("n")))), lambda x: x["n"])


def post_order(nodes: Column) -> Column:
    return F.transform(F.array_sort(F.transform(nodes, lambda n: F.struct(n["subtree_end"].alias("e"), (-n["depth"]).alias("d"), n.alias("n")))), lambda x: x["n"])


def children(nodes: Column, pos: Column) -> Column:
    return F.filter(nodes, lambda n: n["parent"] == pos)


def body(nodes: Column) -> Column:
    """The subtree of the root's last block."""
    blocks = F.filter(children(nodes, F.get(nodes, 0)["pos"]), lambda n: n["ast_type"] == "BlockStmt")
    return let(blocks, lambda b: F.when(F.size(b) > 0, subtree(nodes, F.get(b, F.size(b) - 1)["pos"])))


def signature(nodes: Column) -> Column:
    """Nodes before the root's first block, without the root."""
    blocks = F.filter(children(nodes, F.get(nodes, 0)["pos"]), lambda n: n["ast_type"] == "BlockStmt")
    end = F.when(F.size(blocks) > 0, F.get(blocks, 0)["pos"]).otherwise(F.size(nodes))
    return F.filter(nodes, lambda n: (n["pos"] > 0) & (n["pos"] < end))


def has_type(nodes: Column, ast_type: str) -> Column:
    return F.exists(nodes, lambda n: n["ast_type"] == ast_type)


def without_subtrees(nodes: Column, stop) -> Column:
    """Nodes that don't lie below a node for which stop holds; such nodes themselves stay."""
    stops = F.filter(nodes, stop)
    return let(stops, lambda s: F.filter(nodes, lambda n: ~F.exists(s, lambda x: (n["pos"] > x["pos"]) & (n["pos"] < x["subtree_end"]))))


def mask_literals(nodes: Column, kind: str = "StringLiteralExpr", mask: str = "STR") -> Column:
    """String literals' tokens replaced."""
    return F.transform(nodes, lambda n: n.withField("tok", F.when((n["ast_type"] == kind) & n["tok"].isNotNull(), F.lit(mask)).otherwise(n["tok"])))


def mask_string_constants(insns: Column, mask: str = "STR") -> Column:
    """The token after LDC and String replaced, in a flat token array."""
    return F.transform(insns, lambda t, i: F.when((i >= 2) & (F.get(insns, i - 1) == "String") & (F.get(insns, i - 2) == "LDC"), F.lit(mask)).otherwise(t))


def shape(nodes: Column, constant: str = "<C>") -> Column:
    """Types and tokens in pre-order with constants blanked: trees that are equal but for constants are equal here."""
    return F.transform(nodes, lambda n: F.struct(n["depth"].alias("depth"), n["ast_type"].alias("ast_type"), F.when(n["ast_type"] != constant, n["tok"]).alias("tok")))


def referenced(nodes: Column, ast_type: str) -> Column:
    """Distinct tokens of the nodes of a type, in order."""
    return F.array_distinct(F.transform(F.filter(nodes, lambda n: n["ast_type"] == ast_type), lambda n: n["tok"]))

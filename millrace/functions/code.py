"""Syntax and data-flow match of code, on a light parse of brace languages.

Texts are cut into tokens and nested by brackets: statements end at semicolons and blocks, arguments at commas, a name
before parentheses makes a call, an assignment has a target and a value. It is no full grammar: it needs none of the
parsers that aren't available here, and ill-formed code still gives a tree. Nodes are compared by type, not by text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.metrics import JAVA_KEYWORDS

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>>>>=|<<=|>>=|>>>|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|->|::|<<|>>|.)""", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}


@dataclass
class Node:
    kind: str
    text: str = ""
    children: list[Node] = field(default_factory=list)

    def shape(self) -> str:
        return f"({' '.join([self.kind, *(c.shape() for c in self.children)])})" if self.children else self.kind

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def lexed(code: str) -> list[Node]:
    out = []
    for m in _TOKEN.finditer(code):
        kind = m.lastgroup
        if kind == "name":
            out.append(Node("keyword:" + m[0] if m[0] in JAVA_KEYWORDS else "name", m[0]))
        elif kind == "op":
            out.append(Node(m[0], m[0]))
        elif kind:
            out.append(Node(kind, m[0]))
    return out


def parsed(code: str) -> Node:
    """A tree whose bracket nodes hold what they enclose; a bracket that is never closed ends with the text."""
    root = Node("program")
    stack = [(root, "")]
    for t in lexed(code):
        if t.kind in _CLOSE:
            node = Node({"(": "parens", "[": "index", "{": "block"}[t.kind])
            stack[-1][0].children.append(node)
            stack.append((node, _CLOSE[t.kind]))
        elif len(stack) > 1 and t.kind == stack[-1][1]:
            stack.pop()
        else:
            stack[-1][0].children.append(t)
    return _nested(root)


def _nested(node: Node) -> Node:
    kids = [_nested(c) if c.kind in ("parens", "index", "block") else c for c in node.children]
    if node.kind in ("program", "block"):
        kids = _split(kids, ";", "statement", ends="block")
    elif node.kind == "parens":
        kids = _split(kids, ",", "argument")
    else:
        kids = [_expression(kids, "expression")] if kids else []
    return Node(node.kind, node.text, kids)


def _split(kids: list[Node], at: str, kind: str, ends: str | None = None) -> list[Node]:
    out, part = [], []
    for k in kids:
        if k.kind != at:
            part.append(k)
        if (k.kind == at or k.kind == ends) and part:
            out.append(_expression(part, kind))
            part = []
    return [*out, _expression(part, kind)] if part else out


def _expression(kids: list[Node], kind: str) -> Node:
    for i, k in enumerate(kids):
        if k.kind in _ASSIGN and i:
            return Node(kind, "", [Node("assignment", k.text, [Node("target", "", _calls(kids[:i])), Node(k.kind, k.text), _expression(kids[i + 1 :], "value")])])
    return Node(kind, "", _calls(kids))


def _calls(kids: list[Node]) -> list[Node]:
    out: list[Node] = []
    for k in kids:
        if k.kind == "parens" and out and out[-1].kind == "name":
            out[-1] = Node("call", "", [out[-1], k])
        else:
            out.append(k)
    return out


def syntax_parts(gold: str, pred: str) -> tuple[int, int]:
    """(subtrees of gold whose shape pred has too, subtrees of gold)."""
    have = {n.shape() for n in parsed(pred).walk() if n.children}
    want = [n.shape() for n in parsed(gold).walk() if n.children]
    return sum(x in have for x in want), len(want)


def data_flow(code: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(name, how, sources) in order: an assigned name is computed from the names of the value, a used one comes from
    where it was last seen. Names are numbered by their first place."""
    numbers: dict[str, str] = {}
    edges: list[tuple[str, str, tuple[str, ...]]] = []
    seen: set[str] = set()

    def name(x: str) -> str:
        return numbers.setdefault(x, f"var_{len(numbers)}")

    def used(node: Node) -> list[str]:
        if node.kind == "name":
            return [node.text]
        kids = node.children[1:] if node.kind == "call" else node.children
        return [x for c in kids for x in used(c)]

    def visit(node: Node) -> None:
        if node.kind == "assignment":
            target, op, value = node.children
            visit(value)
            names = used(target)
            if names:
                left = names[-1] if not any(c.kind == "index" for c in target.children) else names[0]
                from_ = dict.fromkeys([*([left] if op.kind != "=" else []), *used(value)])
                edges.append((name(left), "computedFrom", tuple(map(name, from_))))
                seen.add(left)
            return
        if node.kind == "name":
            if node.text in seen:
                edges.append((name(node.text), "comesFrom", (name(node.text),)))
            return
        for c in node.children[1:] if node.kind == "call" else node.children:
            visit(c)

    visit(parsed(code))
    return edges


def data_flow_parts(gold: str, pred: str) -> tuple[int, int]:
    """(edges of gold that pred has too, each as often, edges of gold)."""
    want, have = Counter(data_flow(gold)), Counter(data_flow(pred))
    return sum((want & have).values()), sum(want.values())


PARTS = T.StructType([T.StructField("matched", T.LongType()), T.StructField("total", T.LongType())])


def _udf(parts):
    def run(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parts(g or "", p or "") for g, p in zip(gold, pred, strict=True)], columns=["matched", "total"])

    run.__annotations__ = {"gold": pd.Series, "pred": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, PARTS)


#: Over two columns of code: how much of the first the second matches. Sum both over rows for a corpus.
syntax_match = _udf(syntax_parts)
data_flow_match = _udf(data_flow_parts)


def score(parts: Column) -> Column:
    """100 matched / total; NaN where there is nothing to match."""
    return F.when(parts["total"] > 0, 100.0 * parts["matched"] / parts["total"]).otherwise(float("nan"))

"""Token sequences as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions.base import let, positions, sums
from millrace.functions.names import FIELD_OPS, METHOD_OPS

# Fixed value: places between the parts of an identifier.
SUBTOKEN = r"(?<=[_$])(?!$)|(?<!^)(?=[_$])|(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9]|[A-Z][a-z0-9])|(?<=[0-9])(?=[a-zA-Z])|\b"
# Whole numbers and fractions as constants are written.
INT = r"^-?[0-9]+$"
FLOAT = r"^(?:-?[0-9]*\.?[0-9]+(?:E-?[0-9]+)?|NaN|-?Infinity)$"


PRIMITIVE = frozenset("BCDFIJSZ")


def subtokens(token: Column) -> Column:
    """Lower-cased parts; a token that begins with a word character has an empty part in front."""
    parts = F.transform(F.split(token, SUBTOKEN), F.lower)
    return F.when(token.rlike(r"^\w"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def from_subtokens(parts: Column) -> Column:
    """Joins subtokens, splits at spaces and drops one leading empty token."""
    toks = F.split(F.array_join(parts, ""), " ")
    return let(toks, lambda t: F.when(F.get(t, 0) == "", F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t))


CLASS_DESC = r"\[*L[^;()]*;|\[+[BCDFIJSZ]"
METHOD_DESC = r"\((?:\[*(?:[BCDFIJSZ]|L[^;()]*;))*\)(?:\[*(?:[BCDFIJSZ]|L[^;()]*;)|V)"


def break_descriptors(tokens: Column) -> Column:
    """Descriptors in pieces: brackets, letters, and L, name and ; of each class."""
    def letters(x):
        # what still holds several letters is a run of brackets and primitives
        return F.when(x.rlike(r"^[\[()BCDFIJSZV]+$"), F.filter(F.split(x, ""), lambda c: c != "")).otherwise(F.array(x))

    def of_token(t):
        parts = F.filter(F.split(F.regexp_replace(t, r"L([^;()]*);", "\u0001L\u0002$1\u0001;\u0001"), "\u0001"), lambda x: x != "")
        split = F.transform(parts, lambda p: F.when(p.contains("\u0002"), F.split(p, "\u0002")).otherwise(letters(p)))
        return F.when(t.rlike(f"^(?:{CLASS_DESC}|{METHOD_DESC})$"), F.flatten(split)).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, of_token))


def join_descriptors(tokens: list[str]) -> list[str]:
    """The opposite of break_descriptors: pieces that make a method's or an array's or a class's descriptor are joined,
    all other tokens stay."""

    def type_end(i: int) -> int | None:
        while i < len(tokens) and tokens[i] == "[":
            i += 1
        if i < len(tokens) and tokens[i] in PRIMITIVE:
            return i + 1
        return i + 3 if i + 2 < len(tokens) and tokens[i] == "L" and tokens[i + 2] == ";" else None

    def method_end(i: int) -> int | None:
        i += 1
        while i < len(tokens) and tokens[i] != ")":
            if (end := type_end(i)) is None:
                return None
            i = end
        if i + 1 >= len(tokens):
            return None
        return i + 2 if tokens[i + 1] == "V" else type_end(i + 1)

    out, i = [], 0
    while i < len(tokens):
        end = method_end(i) if tokens[i] == "(" else type_end(i) if tokens[i] in ("[", "L") else None
        out.append("".join(tokens[i:end]) if end else tokens[i])
        i = end or i + 1
    return out


@F.pandas_udf(ArrayType(StringType()))
def recover_descriptors(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else join_descriptors(list(t)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_assertion(text: Column) -> Column:
    """Without the framework's prefix; assertEquals of a truth value as assertTrue or assertFalse, up to the last closing
    parenthesis."""
    plain = F.regexp_replace(text, r"^org \. junit \. Assert \. ", "")
    true = F.regexp_replace(plain, r"(?s)^assertEquals \( true , ([^\n]*) \).*$", "assertTrue ( $1 )")
    return F.regexp_replace(true, r"(?s)^assertEquals \( false , ([^\n]*) \).*$", "assertFalse ( $1 )")


def shorten(value: Column, most: int = 100) -> Column:
    """Long values keep their first most - 4 characters and their last."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 4), F.lit("..."), F.substring(value, -1, 1))).otherwise(value)


def fill(template: Column, statement: Column, placeholder: str = "/*TESTSTMT*/") -> Column:
    return F.replace(template, F.lit(placeholder), statement)


def is_blank(text: Column) -> Column:
    return F.trim(text) == ""


def is_number(text: Column) -> Column:
    return text.rlike(INT) | text.rlike(FLOAT)


def module_line(line: Column) -> Column:
    """(packaging, name, path) of a line of three fields."""
    return let(F.split(F.trim(line), r"\s+", 3), lambda x: F.struct(F.get(x, 0).alias("packaging"), F.get(x, 1).alias("name"), F.get(x, 2).alias("path")))


def log_line(line: Column) -> Column:
    """(name, type, value) of a line split at its first two spaces."""
    return let(F.split(line, " ", 3), lambda x: F.struct(F.get(x, 0).alias("name"), F.get(x, 1).alias("type"), F.get(x, 2).alias("value")))


def ngrams(tokens: Column, n: int, separator: str = "\u0001") -> Column:
    return let(tokens, lambda t: F.transform(positions(F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), separator)))


def padded_ngrams(tokens: Column, n: int, left: str | None = None, right: str | None = None, separator: str = "\u0001") -> Column:
    parts = [F.array_repeat(F.lit(left), n - 1)] * (left is not None) + [tokens] + [F.array_repeat(F.lit(right), n - 1)] * (right is not None)
    return ngrams(F.concat(*parts), n, separator)


def pad(tokens: Column, n: int, value: Column, side: str = "right", cut: str = "right") -> Column:
    """Exactly n elements: cut at one side, filled up at one side."""
    kept = F.slice(tokens, 1, n) if cut == "right" else F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), n)
    fill_ = F.array_repeat(value, F.greatest(n - F.size(tokens), F.lit(0)))
    return F.concat(kept, fill_) if side == "right" else F.concat(fill_, kept)


def keep_last(tokens: Column, n: int) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), n)


def roll_left(tokens: Column, pad_value: Column) -> Column:
    return F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(pad_value))


def mask_value(tokens: Column, value: Column, mask: Column) -> Column:
    return F.transform(tokens, lambda x: F.when(x == value, mask).otherwise(x))


def cut_at(tokens: Column, prefix: str = ";") -> Column:
    """Tokens up to the first that starts with prefix, which becomes prefix itself."""
    first = F.array_position(F.transform(tokens, lambda x: x.startswith(prefix)), True)
    return F.when(first > 0, F.concat(F.slice(tokens, 1, (first - 1).cast("int")), F.array(F.lit(prefix)))).otherwise(tokens)


def until(tokens: Column, ends: Column) -> Column:
    """Tokens before the first that is one of ends."""
    first = F.array_position(F.transform(tokens, lambda x: F.array_contains(ends, x)), True)
    return F.when(first > 0, F.slice(tokens, 1, (first - 1).cast("int"))).otherwise(tokens)


def group_by_ops(tokens: Column, ops: Column) -> Column:
    """Tokens as instructions: each begins with an operation. An unfinished constant (LDC up to LDC_END)
    and the first two operands of an instruction on a method or field hold no operations, even if called like one."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"))

    def step(acc, t):
        now = acc["now"]
        unfinished = (F.get(now, 0) == "LDC") & (F.get(now, F.size(now) - 1) != "LDC_END") | F.get(now, 0).isin(*METHOD_OPS, *FIELD_OPS) & (F.size(now) < 3)
        opens = F.array_contains(ops, t) & ~F.coalesce(unfinished, F.lit(False))
        done = F.when(opens & (F.size(now) > 0), F.concat(acc["done"], F.array(now))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(opens, F.array(t)).otherwise(F.concat(now, F.array(t))).alias("now"))

    return F.aggregate(tokens, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def reverse_insns(insns: Column) -> Column:
    """Instructions in reverse order, each with its operands in order, as one sequence."""
    return F.flatten(F.reverse(insns))


def offsets(parts: Column) -> Column:
    """(begin, end) of each token's subtokens, for an array of arrays."""
    return let(sums(F.transform(parts, F.size)), lambda at: F.transform(positions(F.size(at) - 1), lambda i: F.struct(F.get(at, i - 1).alias("beg"), F.get(at, i).alias("end"))))


def token_of_subtoken(parts: Column) -> Column:
    """Number of the token that each subtoken belongs to."""
    return F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i, F.size(p))))


def shifted(offset_lists: Column) -> Column:
    """Offsets of several subtokenizations put end to end."""
    def of(lists: Column) -> Column:
        last = F.transform(lists, lambda x: F.coalesce(F.get(x, F.size(x) - 1)["end"], F.lit(0)))
        return let(sums(last), lambda at: F.flatten(F.transform(lists, lambda x, i: let(F.get(at, i), lambda s: F.transform(x, lambda o: F.struct((o["beg"] + s).alias("beg"), (o["end"] + s).alias("end")))))))

    return let(offset_lists, of)


def with_inputs(named: list[tuple[str, Column]], separator: str | None = None, first: bool = False, names: bool = False) -> Column:
    """Token sequences of several inputs on end, each token with its input's name. A separator stands before each input
    but the first (or before that too) and is the prefix of the input after it; so are inputs' names, if wanted."""

    def of(toks: Column, name: str) -> Column:
        return F.transform(toks, lambda t: F.struct(t.alias("tok"), F.lit(name).alias("input"), F.lit(None).cast("string").alias("prefix_of")))

    def prefix(tok: str, name: str) -> Column:
        return F.array(F.struct(F.lit(tok).alias("tok"), F.lit(None).cast("string").alias("input"), F.lit(name).alias("prefix_of")))

    parts = []
    for k, (name, toks) in enumerate(named):
        if separator is not None and (k or first):
            parts.append(prefix(separator, name))
        if names:
            parts.append(prefix(name, name))
        parts.append(of(toks, name))
    return F.concat(*parts)


def remove_comments(code: Column) -> Column:
    """Without // and /* */ comments (a space stands for each), string literals left alone, without blank lines."""
    literal = r"'(?:\\.|[^\\'])*'|\"(?:\\.|[^\\\"])*\""
    marked = F.regexp_replace(code, rf"(?s)({literal})|/\*.*?\*/|//[^\n]*", "\u0001$1\u0002")
    plain = F.translate(F.replace(marked, F.lit("\u0001\u0002"), F.lit(" ")), "\u0001\u0002", "")
    return F.array_join(F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != ""), "\n")


def carried_flags(tokens: Column, ops: Column, important: Column, high: float, low: float) -> Column:
    """A scale for each token: that of the last operation at or before it."""

    def step(acc, t):
        scale = F.when(F.array_contains(important, t), F.lit(high)).when(F.array_contains(ops, t), F.lit(low)).otherwise(acc["now"])
        return F.struct(F.concat(acc["out"], F.array(scale)).alias("out"), scale.alias("now"))

    return F.aggregate(tokens, F.struct(F.array().cast("array<double>").alias("out"), F.lit(low).alias("now")), step, lambda a: a["out"])


def is_special(token: Column, specials: list) -> Column:
    """Whether a token (or an id) is one of a tokenizer's special ones; those that it lacks are None."""
    return F.coalesce(token.isin(*(x for x in specials if x is not None)), F.lit(False))


def of_elements(nested: Column, depth: int, body) -> Column:
    """body of every element of arrays nested depth deep."""
    return body(nested) if depth == 0 else F.transform(nested, lambda x: of_elements(x, depth - 1, body))


def of_innermost(nested: Column, depth: int, body) -> Column:
    """body of every innermost array of arrays nested depth deep."""
    return of_elements(nested, depth - 1, body)


def pad_nested(nested: Column, sizes: list[int], value: Column, kind: str = "string") -> Column:
    """Arrays nested as deep as there are sizes, each cut or filled up to its size."""
    if len(sizes) == 1:
        return pad(nested, sizes[0], value)
    blank = value
    for n in reversed(sizes[1:]):
        blank = F.array_repeat(blank, n)
    return pad(F.transform(nested, lambda x: pad_nested(x, sizes[1:], value, kind)), sizes[0], blank)


# Boxed types by the names that logs show.
BOXED = {"java.lang.Boolean": "boolean", "java.lang.Byte": "byte", "java.lang.Character": "char", "java.lang.Double": "double", "java.lang.Float": "float", "java.lang.Integer": "int", "java.lang.Long": "long", "java.lang.Short": "short", "java.lang.String": "String"}


def shown_type(class_name: Column) -> Column:
    """A class as logs show it: boxed types by their plain names, others without package, null as `null`."""
    out = F.element_at(F.split(class_name, r"[.$]"), -1)
    for name, short in BOXED.items():
        out = F.when(class_name == name, F.lit(short)).otherwise(out)
    return F.when(class_name.isNull(), F.lit("null")).otherwise(out)


def sorted_items(map_: Column) -> Column:
    """(key, value) of a map in the order of keys."""
    return F.array_sort(F.map_entries(map_))


def span_text(code: Column, begin: Column, end: Column) -> Column:
    """Text from (line, column) up to another, both from 0; begin and end are structs."""
    lines = F.slice(F.split(code, "\n", -1), begin["line"] + 1, end["line"] - begin["line"] + 1)
    n = F.size(lines)
    cut = F.transform(lines, lambda x, i: F.substr(x, F.when(i == 0, begin["column"] + 1).otherwise(1), F.when(i == n - 1, end["column"] - F.when(i == 0, begin["column"]).otherwise(0)).otherwise(F.length(x))))
    return F.array_join(cut, "\n")

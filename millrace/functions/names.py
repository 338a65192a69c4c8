"""Java names, types, descriptors, access flags and instructions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.base import let

# Descriptor letters of the Java virtual machine.
PRIMITIVES = {"int": "I", "long": "J", "float": "F", "double": "D", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "void": "V"}
# Access flags of class files.
FLAGS = {"public": 0x0001, "private": 0x0002, "protected": 0x0004, "static": 0x0008, "interface": 0x0200, "abstract": 0x0400}
# Instructions by what they refer to.
METHOD_OPS = ("INVOKEVIRTUAL", "INVOKESPECIAL", "INVOKESTATIC", "INVOKEINTERFACE")
FIELD_OPS = ("GETFIELD", "PUTFIELD", "GETSTATIC", "PUTSTATIC")
JUMP_OPS = ("IFEQ", "IFNE", "IFLT", "IFGE", "IFGT", "IFLE", "IF_ICMPEQ", "IF_ICMPNE", "IF_ICMPLT", "IF_ICMPGE", "IF_ICMPGT", "IF_ICMPLE", "IF_ACMPEQ", "IF_ACMPNE", "GOTO", "JSR", "IFNULL", "IFNONNULL")

TYPE = r"\[*(?:[BCDFIJSZV]|L[^;]*;)"
# Packages and the last name behind them, as patterns.
_PACKAGES = r"(?:[a-zA-Z_][a-zA-Z_0-9]*/)+"
_LAST = r"([a-zA-Z_$][a-zA-Z_$0-9]*)"


def internal_name(qualified: Column) -> Column:
    return F.translate(qualified, ".", "/")


def qualified_name(internal: Column) -> Column:
    return F.translate(internal, "/", ".")


def simple_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, r"\."), -1)


def type_descriptor(name: Column) -> Column:
    """`int[]` -> `[I`, `a.b.C` -> `La/b/C;`."""
    base = F.regexp_replace(name, r"(\[\])+$", "")
    depth = ((F.length(name) - F.length(base)) / 2).cast("int")
    letter = F.concat(F.lit("L"), internal_name(base), F.lit(";"))
    for long, short in PRIMITIVES.items():
        letter = F.when(base == long, F.lit(short)).otherwise(letter)
    return F.concat(F.repeat(F.lit("["), depth), letter)


def split_descriptor(types: Column) -> Column:
    return F.regexp_extract_all(types, F.lit(f"({TYPE})"), F.lit(1))


def simplify_type(name: Column) -> Column:
    """Arrays in source notation, primitives by name, classes without package."""
    base = F.regexp_replace(name, r"^\[+", "")
    depth = F.length(name) - F.length(base)
    plain = F.regexp_replace(base, "^.(.*);$", "$1")
    short = F.element_at(F.split(F.element_at(F.split(plain, r"\."), -1), "/"), -1)
    for long, letter in PRIMITIVES.items():
        if long != "void":
            short = F.when(base == letter, F.lit(long)).otherwise(short)
    return F.concat(short, F.repeat(F.lit("[]"), depth))


def strip_package(token: Column) -> Column:
    """Descriptors first, then names."""
    return F.regexp_replace(F.regexp_replace(token, f"L{_PACKAGES}{_LAST};", "L$1;"), _PACKAGES + _LAST, "$1")


def method_descriptor(ptypes: Column, rtype: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(ptypes, type_descriptor), ""), F.lit(")"), type_descriptor(rtype))


def method_namedesc(name: Column, ptypes: Column, rtype: Column) -> Column:
    return F.concat(name, method_descriptor(ptypes, rtype))


def method_key(class_name: Column, name: Column, ptypes: Column, rtype: Column) -> Column:
    return F.concat(internal_name(class_name), F.lit("#"), method_namedesc(name, ptypes, rtype))


def split_method_key(key: Column) -> tuple[Column, Column]:
    """(qualified class name, method name) of `a/b/C#m(...)...`."""
    return qualified_name(F.split_part(key, F.lit("#"), F.lit(1))), F.split_part(F.split_part(key, F.lit("#"), F.lit(2)), F.lit("("), F.lit(1))


def has_flag(access: Column, flag: str) -> Column:
    return access.bitwiseAND(F.lit(FLAGS[flag])) != 0


def is_package_private(access: Column) -> Column:
    return access.bitwiseAND(F.lit(FLAGS["public"] | FLAGS["private"] | FLAGS["protected"])) == 0


def is_test_method(annotations: Column) -> Column:
    # fixed values: annotations of the test frameworks
    yes, no = ("org.junit.Test", "org.junit.jupiter.api.Test"), ("org.junit.Ignore", "org.junit.jupiter.api.Disabled")
    return F.arrays_overlap(annotations, F.array(*map(F.lit, yes))) & ~F.arrays_overlap(annotations, F.array(*map(F.lit, no)))


# Annotations of methods that run before or after tests.
SETUP = {"before": ("org.junit.Before", "org.junit.jupiter.api.BeforeEach"), "before_all": ("org.junit.BeforeClass", "org.junit.jupiter.api.BeforeAll"), "after": ("org.junit.After", "org.junit.jupiter.api.AfterEach"), "after_all": ("org.junit.AfterClass", "org.junit.jupiter.api.AfterAll")}


def setup_kind(annotations: Column) -> Column:
    chain = F.lit(None).cast("string")
    for kind, names in SETUP.items():
        chain = F.when(F.arrays_overlap(annotations, F.array(*map(F.lit, names))), F.lit(kind)).otherwise(chain)
    return chain


def is_assertion_name(name: Column) -> Column:
    return name.startswith("assert") | name.startswith("fail")


def is_assertion(tokens: Column) -> Column:
    first = F.get(tokens, 0)
    return F.coalesce((first == "Assert") | is_assertion_name(first), F.lit(False))


# instructions: arrays of an operation and its operands

def op(insn: Column) -> Column:
    return F.get(insn, 0)


def is_method_insn(insn: Column) -> Column:
    return op(insn).isin(*METHOD_OPS)


def is_field_insn(insn: Column) -> Column:
    return op(insn).isin(*FIELD_OPS)


def is_jump_insn(insn: Column) -> Column:
    return op(insn).isin(*JUMP_OPS)


def insn_class(insn: Column) -> Column:
    return F.when(is_method_insn(insn), "method").when(is_field_insn(insn), "field").when(is_jump_insn(insn), "jump").when(op(insn) == "LABEL", "label").otherwise("other")


def insn_owner(insn: Column) -> Column:
    return F.get(insn, 1)


def insn_namedesc(insn: Column) -> Column:
    return F.concat(F.get(insn, 2), F.get(insn, 3))


def insn_parameter_types(insn: Column) -> Column:
    return split_descriptor(F.regexp_extract(F.get(insn, 3), r"\(([^)]*)\)", 1))


def insn_argument_count(insn: Column) -> Column:
    return F.size(insn_parameter_types(insn)) + F.when(op(insn) == "INVOKESTATIC", 0).otherwise(1)


# types of stack values, as descriptors

def type_group(descriptor: Column) -> Column:
    return F.when(descriptor.isin("I", "B", "Z", "C", "S"), "int").when(descriptor.startswith("L") | descriptor.startswith("["), "reference").otherwise(descriptor)


def assignable(a: Column, b: Column) -> Column:
    """Any reference to any reference, any int-like to any int-like, else equal names."""
    return type_group(a) == type_group(b)


def accepts(values: Column, parameters: Column, extra: int = 0) -> Column:
    """Whether the top of a stack of values suits parameters (extra: a receiver below them)."""
    n = F.size(parameters)
    top = F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)
    fits = F.forall(F.zip_with(top, parameters, assignable), lambda x: x)
    return (F.size(values) >= n + extra) & F.coalesce(fits, F.lit(False))


def line_range(lines: Column) -> Column:
    """`12` or `12-15` as (first, last)."""
    return let(F.split(lines, "-"), lambda x: F.struct(F.get(x, 0).cast("int").alias("first"), F.coalesce(F.get(x, 1), F.get(x, 0)).cast("int").alias("last")))

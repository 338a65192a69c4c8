"""Name resolution over class tables: inheritance closures and lookups of methods and fields.

classes: (cid, ext, impl array, name, access, scope); methods: (mid, cid, namedesc, access); fields: (fid, cid, name).
Missing links are null (negative ids count as missing). Distinct keys are resolved once and joined back.

Closures are loops of joins whose rounds are written, so plans stay small whatever the depth. Superclasses are
found by doubling: the 2^k-th superclass of each class is joined in round k. Superinterfaces are found level by level;
pairs already found aren't followed again, which ends cycles too."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import has_flag
from millrace.sources.scratch import saved


def link(id: Column) -> Column:
    return F.when(id >= 0, id)


def superclasses(classes: DataFrame, start: DataFrame) -> DataFrame:
    """(cid, ancestor, depth): start's classes themselves (depth 0) and their superclasses, at their least depth."""
    jump = saved(classes.select("cid", link(F.col("ext")).alias("to")).where("to is not null"), "jump")
    up = start.select("cid").distinct().select("cid", F.col("cid").alias("ancestor"), F.lit(0).alias("depth"))
    size, links = 1, jump.count()
    # no chain is longer than there are links, so cycles end too
    while size <= links and not jump.isEmpty():
        up = saved(up.groupBy("cid", "ancestor").agg(F.min("depth").alias("depth")), "up") if size > 1 else up
        above = up.join(jump.withColumnRenamed("cid", "ancestor"), "ancestor").select("cid", F.col("to").alias("ancestor"), (F.col("depth") + size).alias("depth"))
        up = up.union(above)
        twice = jump.select("cid", F.col("to").alias("mid")).join(jump.select(F.col("cid").alias("mid"), "to"), "mid")
        jump = saved(twice.select("cid", "to"), "jump")
        size *= 2
    return up.groupBy("cid", "ancestor").agg(F.min("depth").alias("depth"))


def superinterfaces(classes: DataFrame, start: DataFrame) -> DataFrame:
    """(cid, ancestor, rank): superinterfaces of start's classes in breadth-first order, each at its first place."""
    edges = classes.select(F.col("cid").alias("ancestor"), F.posexplode("impl").alias("pos", "to")).where("to >= 0")
    now = start.select("cid").distinct().select("cid", F.col("cid").alias("ancestor"), F.array().cast("array<int>").alias("place"))
    found = None
    for depth in count(1):
        there = now.join(edges, "ancestor").where("to != cid").groupBy("cid", F.col("to").alias("ancestor")).agg(F.min(F.concat("place", F.array("pos"))).alias("place"))
        if found is not None:
            there = there.join(found, ["cid", "ancestor"], "left_anti")
        now = saved(there.withColumn("depth", F.lit(depth)), "interfaces")
        if depth > 1 and now.isEmpty():
            break
        found = now if found is None else found.union(now)
    return found.select("cid", "ancestor", F.row_number().over(Window.partitionBy("cid").orderBy("depth", "place")).cast("int").alias("rank"))


def lookup_class(owners: DataFrame, classes: DataFrame, owner: str = "owner") -> DataFrame:
    """owners with cid; of classes of one name the last wins; owners without class are dropped."""
    last = classes.groupBy(F.translate("name", ".", "/").alias(owner)).agg(F.max("cid").alias("cid"))
    return owners.join(last, owner)


def _unique(members: DataFrame, key: str, id: str) -> DataFrame:
    """The last member of each (class, name)."""
    return members.groupBy("cid", key).agg(F.max_by(F.struct(*members.columns), id).alias("m")).select("m.*")


def _in_order(asked: DataFrame, closure: DataFrame, methods: DataFrame, order: str) -> DataFrame:
    """asked's (cid, namedesc) with the members of the classes in closure, in order."""
    return asked.join(closure, "cid").join(methods.select(F.col("cid").alias("ancestor"), "namedesc", "mid", "access"), ["ancestor", "namedesc"]).select("cid", "namedesc", "mid", "access", F.col(order).alias("at"))


def lookup_methods(asked: DataFrame, classes: DataFrame, methods: DataFrame, object_name: str = "java.lang.Object") -> DataFrame:
    """asked (cid, namedesc, op) with mid, which is null where nothing is found.

    virtual: the class and its superclasses, nearest first; then its superinterfaces breadth-first, where the first
    abstract one found before the first other one wins; none for interfaces. interface: the interface, Object's public
    instance methods, then superinterfaces; none for classes. special: virtual, else interface. static: the class."""
    methods = _unique(methods, "namedesc", "mid")
    keys = asked.select("cid", "namedesc").distinct().join(classes.select("cid", has_flag(F.col("access"), "interface").alias("is_interface")), "cid")
    up = _in_order(keys, superclasses(classes, keys), methods, "depth").groupBy("cid", "namedesc").agg(F.min_by("mid", "at").alias("in_class"), F.min(F.when(F.col("at") == 0, F.col("mid"))).alias("own"))
    side = _in_order(keys, superinterfaces(classes, keys), methods, "rank").withColumn("abstract", has_flag(F.col("access"), "abstract"))
    side = side.groupBy("cid", "namedesc").agg(
        F.min(F.when(F.col("abstract"), F.struct("at", "mid"))).alias("a"), F.min(F.when(~F.col("abstract"), F.struct("at", "mid"))).alias("c")
    ).select("cid", "namedesc", F.when(F.col("a").isNotNull() & (F.col("c").isNull() | (F.col("a.at") < F.col("c.at"))), F.col("a.mid")).otherwise(F.col("c.mid")).alias("in_interface"))
    root = classes.where(F.col("name") == object_name).select(F.col("cid").alias("root"))
    top = methods.join(root, methods["cid"] == root["root"]).where(has_flag(F.col("access"), "public") & ~has_flag(F.col("access"), "static")).select("namedesc", F.col("mid").alias("in_object"))
    found = keys.join(up, ["cid", "namedesc"], "left").join(side, ["cid", "namedesc"], "left").join(top, "namedesc", "left")
    virtual = F.when(~F.col("is_interface"), F.coalesce("in_class", "in_interface"))
    interface = F.when(F.col("is_interface"), F.coalesce("own", "in_object", "in_interface"))
    mid = F.when(F.col("op") == "INVOKEVIRTUAL", virtual).when(F.col("op") == "INVOKEINTERFACE", interface).when(F.col("op") == "INVOKESPECIAL", F.coalesce(virtual, interface)).when(F.col("op") == "INVOKESTATIC", F.col("own"))
    return asked.join(found, ["cid", "namedesc"], "left").select(*(asked[c] for c in asked.columns if c not in ("cid", "namedesc")), "cid", "namedesc", mid.alias("mid"))


def lookup_fields(asked: DataFrame, classes: DataFrame, fields: DataFrame) -> DataFrame:
    """asked (cid, name) with fid: at each class from the nearest, itself, then its direct interfaces in order."""
    fields = _unique(fields, "name", "fid")
    keys = asked.select("cid", "name").distinct()
    up = superclasses(classes, keys)
    direct = classes.select(F.col("cid").alias("ancestor"), F.posexplode("impl").alias("pos", "place")).where("place >= 0")
    places = up.select("cid", "depth", F.lit(-1).alias("pos"), F.col("ancestor").alias("place")).union(up.join(direct, "ancestor").select("cid", "depth", "pos", "place"))
    found = keys.join(places, "cid").join(fields.select(F.col("cid").alias("place"), "name", "fid"), ["place", "name"])
    found = found.groupBy("cid", "name").agg(F.min_by("fid", F.struct("depth", "pos")).alias("fid"))
    return asked.join(found, ["cid", "name"], "left")


def override_edges(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(mid, overridden): the farthest superclass's method of the same name, and those of all superinterfaces."""
    own = methods.select("cid", "mid", "namedesc")
    of = methods.select(F.col("cid").alias("ancestor"), F.col("mid").alias("overridden"), "namedesc")
    far = own.join(superclasses(classes, classes), "cid").where("depth > 0").join(of, ["ancestor", "namedesc"]).groupBy("mid").agg(F.max_by("overridden", "depth").alias("overridden"))
    side = own.join(superinterfaces(classes, classes), "cid").join(of, ["ancestor", "namedesc"]).select("mid", "overridden")
    return far.union(side).distinct()


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes within so many steps of each root, at their least depth. edges: (src, dst)."""
    now = start.select(F.col("root"), F.col("node"), F.lit(0).alias("depth"))
    every = now
    for k in range(depth):
        now = now.join(edges, now["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.lit(k + 1).alias("depth")).distinct()
        every = every.union(now)
    return every.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def fields_set(calls: DataFrame, puts: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(root, fid): fields that root's method, or one that it calls within depth steps, assigns. puts: (mid, fid)."""
    return reachable(calls, start, depth).join(puts.withColumnRenamed("mid", "node"), "node").select("root", "fid").distinct()


def edges_from(edges: DataFrame, node: Column | int) -> DataFrame:
    return edges.where(F.col("src") == node)


def edges_to(edges: DataFrame, node: Column | int) -> DataFrame:
    return edges.where(F.col("dst") == node)


def call_edges(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Distinct (src, dst) of calls (src, owner, namedesc, op)."""
    return lookup_methods(lookup_class(calls, classes), classes, methods).where("mid is not null").select("src", F.col("mid").alias("dst")).distinct()


def by_signature(source: DataFrame, compiled: DataFrame) -> DataFrame:
    """source (cls, sign, ...) with the compiled method of the same signature, else of the same without numbers of
    local classes."""
    loose = F.regexp_replace("sign", r"\$\d+", r"\$")
    exact = compiled.select("cls", "sign", F.col("mid").alias("exact_"))
    rough = compiled.select("cls", loose.alias("loose_"), "mid").groupBy("cls", "loose_").agg(F.min("mid").alias("rough_"))
    return source.withColumn("loose_", loose).join(exact, ["cls", "sign"], "left").join(rough, ["cls", "loose_"], "left").withColumn("mid", F.coalesce("exact_", "rough_")).drop("loose_", "exact_", "rough_")

"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors that are equal and have equal labels form a class, of which one is compared. Each label has cells of its own,
whose number grows with the label; centres are fitted on its rows of a bounded sample (SAMPLE rows; a label of fewer than
eight rows there has one cell, and at most a quarter as many cells as rows). A vector's home is the cell of its nearest centre. Two unit vectors of cosine >= t are at most
d = sqrt(2 - 2t) apart; if their homes differ, the plane half way between the two centres parts them, so one of them
is at most d / 2 from it. Hence every vector also visits each cell whose parting plane is that near: every pair meets
in the home of one of the two, and no link is lost, however good the centres are. Within (label, cell), blocks of
vectors are multiplied with blocks; a pair that meets in both homes counts in the smaller one. Links are counted where
they are found; components run over roots, and the vector of the smallest vec_id of each component is kept.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; nor do vectors
with a null label or without vec_id; vectors of different lengths never link; rows that share a vec_id are one vector:
equal ones count once, different ones are never linked with each other, and each of its rows gets the links of all; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import block_pairs, by_group, linked
from millrace.llm.common import saved
from millrace.llm.components import components
from millrace.llm.samples import first_by_hash

THRESHOLD = 0.98
SAMPLE = 16384
#: Vectors of a label that a cell would hold if its cells were even.
PER_CELL = 1000
BLOCK = 1024
SEED = 5


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """k unit centres of unit vectors x."""
    r = np.random.default_rng(seed)
    centres = x[np.sort(r.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        # a centre that nothing chose stays
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def _valid(v):
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(v, good) & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a vector."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = _valid(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # a digest of the vector stands for it where classes are joined; -0.0 is 0.0
    digest = F.md5(F.to_json(F.struct(F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))))
    keyed = saved(rows.withColumn("class", F.when(usable, F.concat_ws(":", digest, F.col("label")))).select("vec_id", "label", "class", F.when(usable, F.col("v")).alias("v")), "vectors")
    classes = saved(keyed.where("class is not null").groupBy("class").agg(F.min(F.struct("vec_id", "label", "v")).alias("m"), F.count_distinct("vec_id").alias("n")).select("class", "n", F.col("m.vec_id").alias("id"), F.col("m.label").alias("label"), F.col("m.v").alias("v")), "classes")
    total = classes.count()
    sample = first_by_hash(classes.select("id", "label", "v"), SAMPLE, "id", total).select("label", "v").toPandas()
    centres = {}
    for key, own in sample.groupby(["label", sample["v"].map(len)])["v"]:
        # two cells at least, and no more than a sample of four vectors each can tell apart
        many = max(2, -(-len(own) * total // (len(sample) * PER_CELL)))
        if len(own) >= 8:
            centres[key] = spherical_kmeans(unit(np.stack(own.to_list())), int(min(many, len(own) // 4)))
    reach = np.sqrt(2 - 2 * threshold) / 2 + 1e-9

    def assign(batches):
        gaps = {s: np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0)) for s, c in centres.items()}
        for pdf in batches:
            length = pdf["v"].map(len)
            home_of, visits_of = np.zeros(len(pdf), np.int64), [None] * len(pdf)
            for s, at in pdf.groupby(["label", length]).indices.items():
                if s not in centres:
                    for k in at:
                        visits_of[k] = np.array([0])
                    continue
                near = unit(np.stack([pdf["v"].iloc[k] for k in at])) @ centres[s].T
                home = near.argmax(axis=1)
                behind = near[np.arange(len(at)), home][:, None] - near
                for k, h, ok in zip(at, home, behind <= reach * gaps[s][home] + 1e-12, strict=True):
                    home_of[k] = h
                    visits_of[k] = np.flatnonzero(ok)
            yield pdf.assign(size=length.to_numpy(), home=home_of, visits=visits_of)

    placed = saved(classes.select("label", "id", "n", "v").mapInPandas(assign, "label string, id long, n long, v array<double>, size int, home int, visits array<int>"), "placed")
    met = placed.withColumn("cell", F.explode("visits"))
    group = ["label", "size", "cell"]
    sizes = placed.select("label", "size", F.explode("visits").alias("cell")).groupBy(group).agg(F.count(F.lit(1)).alias("many"))

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        x = unit(np.stack(g["v"].to_list()))
        own, ids, home, weight = (g[c].to_numpy() for c in ("own", "id", "home", "n"))
        i, j, cell = g["i"].iloc[0], g["j"].iloc[0], g["cell"].iloc[0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        ok = (ids[a] != ids[b]) & ((home[a] == cell) | (home[b] == cell))
        if i == j:
            ok &= a < b
        a, b = a[ok], b[ok]
        # pairs of one vector at home and one visitor that also meet in the visitor's home, a smaller cell
        mixed = np.flatnonzero(home[a] != home[b])
        if len(mixed):
            seen = g["visits"].to_list()
            out = []
            for k in mixed:
                here, away = (a[k], b[k]) if home[a[k]] == cell else (b[k], a[k])
                if home[away] < cell and home[away] in seen[here]:
                    out.append(k)
            a, b = np.delete(a, out), np.delete(b, out)
        return linked(ids, weight, a, b)

    dealt = block_pairs(met.join(sizes, group), "many", "id", BLOCK)
    found = saved(by_group(dealt, [*group, "i", "j"], compare, "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("class", "n", "id").join(links, "id", "left").join(roots, "id", "left")
    return keyed.select("vec_id", "class").join(of_class, "class", "left").select(
        "vec_id",
        F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "id", "vec_id")).alias("kept"),
    )

"""Cosine operators over arrays of floats."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import cosine

from .closure import cut


#: Probes that are broadcast at once.
PROBES = 2_000


def tag(items: DataFrame, probes: DataFrame, least: float) -> DataFrame:
    """(id, tags): the sorted names of the probes with cosine ``least`` or more, for every item.

    Every item meets every probe, a stated vocabulary: slices of about PROBES of them are broadcast one after the other.
    """
    p = probes.select("name", F.col("v").alias("pv"))
    n = max(1, -(-p.count() // PROBES))
    hits = [items.join(F.broadcast(p.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i)), cosine(F.col("v"), F.col("pv")) >= least).select("id", "name") for i in range(n)]
    every = reduce(DataFrame.unionByName, hits, items.select("id", F.lit(None).cast("string").alias("name")))
    return every.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("tags"))


#: Vectors of a block, and rows of a block that are compared with another at once: 32 MB of cosines.
BLOCK, STRIPE = 4_096, 1_024


def duplicates(items: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b: every pair of near-equal vectors of (id, v).

    Equal vectors are one class: its smallest id stands for it, and other members pair with that id only, so that a large
    group of copies gives as many rows as it has members. Distinct vectors are compared all with all, in pairs of blocks of
    about ``block`` vectors, by products of unit vectors. The work grows with the square of the distinct vectors.
    """
    classes = cut(items.groupBy("v").agg(F.min("id").alias("rep")))
    copies = items.join(classes, "v").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    n = -(-classes.count() // block) or 1
    own = F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    # Block i meets every block j: a vector goes to the pairs (min, max) of its own block and each other one.
    met = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = classes.select("rep", F.col("v").cast("array<double>").alias("v"), own.alias("own"), F.explode(met).alias("p")).select("rep", "v", "own", "p.i", "p.j")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), float)
        norm = np.linalg.norm(x, axis=1)
        some = norm > 0
        unit, ids, left = x[some] / norm[some, None], pdf["rep"].to_numpy()[some], pdf["own"].to_numpy()[some] == key[0]
        u, ui = unit[left], ids[left]
        w, wi = (u, ui) if key[0] == key[1] else (unit[~left], ids[~left])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(u), STRIPE):
            products = u[at : at + STRIPE] @ w.T
            r, c = np.nonzero(products >= least)
            if key[0] == key[1]:
                r, c = r[ui[at + r] < wi[c]], c[ui[at + r] < wi[c]]
            found.append((np.minimum(ui[at + r], wi[c]), np.maximum(ui[at + r], wi[c]), products[r, c]))
        return pd.DataFrame(dict(zip(("a", "b", "cosine"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    pairs = dealt.groupBy("i", "j").applyInPandas(compare, "a long, b long, cosine double")
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine")).unionByName(copies)

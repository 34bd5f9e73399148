"""Mixing sources to target token counts by entropy balancing.

Each document starts at rate 1 and gets the rate closest to it (in relative
entropy) under two conditions: the words of a source sum to its target, and
no rate exceeds ``MAX_RATE``.  The solution tilts exponentially,
``rate = min(MAX_RATE, exp(lambda_s * x))`` with ``x`` the document's size in
units of its source's mean size, and ``lambda_s`` solves a one-dimensional
convex dual.  Newton steps solve all sources' duals at once: Spark sums value
and slope over all documents, the driver holds one number per source.

The rate depends on a document only through source and size, so the sums run
over the (source, size) counts, which are written once.

Rates become copies by carrying the rounding error from document to document
in falling order of size, within groups of about ``GROUP`` documents dealt by
hash.  The error left is about the smallest document of each group.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import SPACE_WORD, cut

#: No document is taken more often than this; targets stop there too.
MAX_RATE = 3.0
#: Weights of the sources, by code point of their names, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents whose rounding errors are carried together.
GROUP = 4096
#: Newton stops at this relative distance from every target.
TOLERANCE = 1e-6


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, row)``, written once."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"),
                           F.monotonically_increasing_id().alias("row")), "sizes")


def targets(sizes: list[float], weights: list[float], cap: float = MAX_RATE) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size, the excess reshared."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / w > cap * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in above:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_RATE) -> pd.DataFrame:
    """One row per source: ``source, n_docs, size, target``, in the order of the weights.

    The only thing the driver holds: a mix names its sources, so their number
    is that of a configuration, not of the documents.
    """
    found = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    size = [float(r["size"]) for r in found]
    return pd.DataFrame({"source": [r["source"] for r in found], "n_docs": [r["n_docs"] for r in found],
                         "size": size, "target": targets(size, [weights[i % len(weights)] for i in
                                                                range(len(found))], cap)})


def solve(rows: DataFrame, goal: pd.DataFrame, cap: float = MAX_RATE, tolerance: float = TOLERANCE) -> np.ndarray:
    """The multiplier of each source: Newton on the dual, kept within a bracket."""
    spark, k = rows.sparkSession, len(goal)
    size, target = goal["size"].to_numpy(), goal["target"].to_numpy()
    mean = np.maximum(size / np.maximum(goal["n_docs"].to_numpy(), 1), 1.0)
    lam, low, high = np.zeros(k), np.full(k, -np.inf), np.full(k, np.inf)
    lam[target >= cap * size] = np.inf                        # every rate at the cap
    open_ = np.isfinite(lam) & (size > 0)
    hist = cut(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    for _ in range(200):
        if not open_.any():
            break
        step = spark.createDataFrame([(goal["source"][i], float(lam[i]), float(mean[i]))
                                      for i in np.flatnonzero(open_)], "s string, lam double, mean double")
        x = F.col("size") / F.col("mean")
        e = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        sums = {r["source"]: (r["f"], r["d"]) for r in
                hist.join(F.broadcast(step), hist["source"].eqNullSafe(step["s"]))
                .groupBy("source").agg(F.sum(F.col("n") * F.col("size") * F.least(e, F.lit(cap))).alias("f"),
                                       F.sum(F.when(e < cap, F.col("n") * F.col("size") * x * e)
                                             .otherwise(0.0)).alias("d")).collect()}
        for i in np.flatnonzero(open_):
            f, d = sums[goal["source"][i]]
            f -= target[i]
            if abs(f) <= tolerance * target[i]:
                open_[i] = False
                continue
            low[i], high[i] = (lam[i], high[i]) if f < 0 else (low[i], lam[i])
            new = lam[i] - f / d if d > 0 else math.nan
            if not low[i] < new < high[i]:                    # outside the bracket: halve or double
                if np.isfinite(low[i]) and np.isfinite(high[i]):
                    new = (low[i] + high[i]) / 2
                else:
                    new = 2 * lam[i] + (1 if f < 0 else -1)
            if new == lam[i] or high[i] - low[i] < 1e-13 * max(1.0, abs(lam[i])):
                open_[i] = False
            lam[i] = new
    return lam


def _round_group(cap: float):
    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order", "row"], ascending=[False, True, True], kind="stable")
        size, rate = pdf["size"].to_numpy(float), pdf["rate"].to_numpy(float)
        base = np.floor(rate + 1e-9)
        taken, error = base.copy(), 0.0
        for i in range(len(size)):
            error += (rate[i] - base[i]) * size[i]
            if error > 0 and error >= size[i] / 2 and base[i] + 1 <= cap and rate[i] > base[i]:
                taken[i] += 1
                error -= size[i]
        return pd.DataFrame({"row": pdf["row"], "copies": taken.astype("int64")})
    return copies


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_RATE, group: int = GROUP) -> DataFrame:
    """Copies of every document so that sources meet their targets.

    ``docs`` needs ``doc_id, text, source``; other columns are ignored.
    Returns one row per input row: ``doc_id, source, size, source_size,
    target, rate, copies, taken``.

    Null text has size 0; null source is a source of its own, last in order;
    documents of size 0 are copied once and take no words.  Rows repeated
    with the same id are documents of their own.  No rows give no rows.
    Rounding order comes from a hash of the id, so reruns agree.
    """
    spark = docs.sparkSession
    rows = sized(docs)
    goal = source_targets(rows, weights, cap)
    lam = solve(rows, goal, cap)
    per = spark.createDataFrame(
        [(r.source, int(r.size_), float(r.target), float(min(l, 1e300)), max(r.size_ / max(r.n_docs, 1), 1.0),
          max(1, math.ceil(r.n_docs / group)))
         for r, l in zip(goal.rename(columns={"size": "size_"}).itertuples(), lam)],
        "s string, source_size long, target double, lam double, mean double, groups long")
    x = F.col("size") / F.col("mean")
    rated = (rows.join(F.broadcast(per), rows["source"].eqNullSafe(per["s"])).drop("s")
             .withColumn("rate", F.when(F.col("size") == 0, 1.0)
                         .otherwise(F.least(F.exp(F.least(F.col("lam") * x, F.lit(700.0))), F.lit(cap))))
             .withColumn("order", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")))
    rated = cut(rated.withColumn("group", F.pmod(F.col("order"), F.col("groups"))), "rates")
    copies = (rated.select("row", "order", "size", "rate", "source", "group")
              .groupBy("source", "group").applyInPandas(_round_group(cap), "row long, copies long"))
    return (rated.join(copies, "row")
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))

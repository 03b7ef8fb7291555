"""Sketches as columns: built once for fine groups, stored, and merged into any coarser ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the number of buckets, and of entries, of distinct counts: errors of 1.6 and 1.6 % (one standard deviation).
HLL_BUCKETS, THETA_ENTRIES = 12, 12
#: Size of quantile sketches: ranks within 1.33 % with 99 % confidence.
KLL_SIZE = 200


def sketched(df: DataFrame, by: Sequence[str], key: str, number: str) -> DataFrame:
    """by, n, hll and theta of distinct ``key``, kll of ``number``: one row for each group; nulls count in n only.

    A group of nulls alone has empty sketches.  Tasks sum up before the shuffle, whatever a group's size.
    """
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(key, HLL_BUCKETS).alias("hll"),
        F.theta_sketch_agg(key, THETA_ENTRIES).alias("theta"),
        F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(KLL_SIZE)).alias("kll"),
    )


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``sketched`` or of this, summed up to coarser groups; without ``by`` to one."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", THETA_ENTRIES).alias("theta"), F.kll_merge_agg_double("kll", F.lit(KLL_SIZE)).alias("kll")
    )


def estimated(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """The sketches' columns replaced by hll_distinct, theta_distinct and q<percent> of each quantile, null where there are no numbers."""
    # a sketch that saw its values in order, in one task, would be read by another formula than a merged one of equal buckets: a union with itself is a merged one
    some = F.kll_sketch_get_n_double("kll") > 0
    read = [F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    others = [c for c in sketches.columns if c not in ("hll", "theta", "kll")]
    return sketches.select(*others, F.hll_sketch_estimate(F.hll_union("hll", "hll")).alias("hll_distinct"), F.theta_sketch_estimate("theta").alias("theta_distinct"), *read)

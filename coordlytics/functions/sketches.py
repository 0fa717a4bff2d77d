"""Summaries that can be stored and merged over wider windows: distinct counts and quantiles with a stated error.

A distinct count is a HyperLogLog sketch of 2^14 registers: a standard error of 0.8 percent, a few values are exact. Quantiles of whole
numbers are KLL sketches with k = 200: the rank of an answer is off by at most 1.7 percent of all values in 99 of 100
cases, and up to 200 values are exact. The exact forms (`quantiles`, two-level counts) stay the default; sketches are for
what is asked again over days, months and years without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LG_REGISTERS, KLL_K = 14, 200
RELATIVE_ERROR, RANK_ERROR = 0.008, 0.017
_DISTINCT, _RANKED = "_hll", "_kll"


def distinct_sketch(value: Column | str, name: str) -> Column:
    return F.hll_sketch_agg(value, F.lit(LG_REGISTERS)).alias(f"{name}{_DISTINCT}")


def quantile_sketch(value: Column | str, name: str) -> Column:
    """Of whole numbers; nulls do not count."""
    return F.kll_sketch_agg_bigint(value, F.lit(KLL_K)).alias(f"{name}{_RANKED}")


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the groups ``by``, and sums of the other numbers. Every task merges its own groups first."""
    out = []
    for field in sketches.schema:
        if field.name in by:
            continue
        if field.name.endswith(_DISTINCT):
            out.append(F.hll_union_agg(field.name).alias(field.name))
        elif field.name.endswith(_RANKED):
            out.append(F.kll_merge_agg_bigint(field.name).alias(field.name))
        elif field.dataType.typeName() in ("long", "integer", "double"):
            out.append(F.sum(field.name).alias(field.name))
    return sketches.groupBy(*by).agg(*out)


def distinct_estimate(name: str) -> Column:
    return F.hll_sketch_estimate(f"{name}{_DISTINCT}")


def quantile_estimate(name: str, share: float) -> Column:
    """The lowest value that ``share`` of all values do not exceed; null without values."""
    sketch = F.col(f"{name}{_RANKED}")
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(share)))

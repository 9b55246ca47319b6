"""Column statistics as sketches that merge: distinct values by HyperLogLog, quantiles by KLL, in a few kilobytes a column.

A state tells of a part of a table what counts, sums and sketches can; states of parts add up to the state of the whole, so parts
are read once, at different times, and only states are kept and shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the register number: a relative error of about 1.04 / sqrt(2 ** bits) for distinct values, 1.6 % here.
HLL_BITS = 12
#: Size of a KLL sketch: about 1.3 % of rank error at 200.
KLL_SIZE = 200


def column_states(df: DataFrame, columns: list[str], part: Column | None = None) -> DataFrame:
    """Rows (part, column_name, rows, nulls, bytes, distinct, lengths, numbers): the state of each column in each part.

    ``part`` is any expression over the rows (null: one part, as without it). ``distinct`` is an HLL sketch of the values as text,
    ``lengths`` a KLL sketch of their lengths in characters, ``numbers`` one of those values that are numbers. One scan, one
    aggregation with map-side combine, of which a task hands on one row for each part.
    """
    sums = []
    for c in columns:
        text = F.col(c).cast("string")
        number = F.try_to_number(text, F.lit("S999999999999999999.999999")).cast("double") if df.schema[c].dataType.simpleString() == "string" else F.col(c).try_cast("double")
        state = F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("rows"),
            F.count_if(text.isNull()).alias("nulls"),
            F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"),
            F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias("distinct"),
            F.kll_sketch_agg_double(F.length(text).cast("double"), F.lit(KLL_SIZE)).alias("lengths"),
            F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias("numbers"),
        )
        sums.append(state.alias(f"__{len(sums)}"))
    by = F.lit(None).cast("string") if part is None else part.cast("string")
    once = df.groupBy(by.alias("part")).agg(*sums)
    return once.select("part", F.explode(F.array(*(F.col(f"__{i}") for i in range(len(sums))))).alias("x")).select("part", "x.*")


def merged_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The states of all parts as one for each column (and each value of ``by``); merging in any order or grouping gives the same
    counts, and sketches within the same bounds."""
    keys = by or ["column_name"]
    return states.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.sum("bytes").alias("bytes"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("lengths").alias("lengths"),
        F.kll_merge_agg_double("numbers").alias("numbers"),
    )


def told(states: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """Rows (column_name, rows, nulls, avg_bytes, distinct, numeric, length_<q>, number_<q>) of states: estimates of what the
    sketches hold. Quantiles are null where there is no value."""
    ranks = quantiles or [0.5, 0.95]

    def at(sketch: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(q)))

    named = [at(s, q).alias(f"{name}_{int(q * 100)}") for s, name in (("lengths", "length"), ("numbers", "number")) for q in ranks]
    filled = F.col("rows") - F.col("nulls")
    return states.select(
        "column_name",
        "rows",
        "nulls",
        F.round(F.try_divide("bytes", filled), 6).alias("avg_bytes"),
        F.hll_sketch_estimate("distinct").alias("distinct"),
        F.coalesce(F.try_divide(F.kll_sketch_get_n_double("numbers"), filled), F.lit(0.0)).alias("numeric"),
        *named,
    )


def latency_states(events: DataFrame, by: Column, value: Column, name: str = "hour") -> DataFrame:
    """Rows (name, requests, latencies): a KLL sketch of the values of each group, to be merged and asked for percentiles."""
    return events.groupBy(by.alias(name)).agg(F.count("*").alias("requests"), F.kll_sketch_agg_double(value.cast("double"), F.lit(KLL_SIZE)).alias("latencies"))

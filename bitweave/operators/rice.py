"""Rice-style coding of folded differences, a gaggle of sixteen blocks at a time.

A number is a run of zeros and a one for its high part and k plain bits for the
rest. k is chosen for each gaggle, from the sum alone or by comparing the coded
sizes of all k; `uncoded` sends plain numbers where that isn't longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweave.functions import bits as B
from bitweave.operators.segments import KEY

MOST_K = 8


def _gaggles(rows: DataFrame, delta: str, n: str, value: Column) -> DataFrame:
    """One row for each gaggle: numbers in order, their count and sums of their parts above k bits."""
    sums = [F.sum(B.shr(F.col(delta), k)).alias(f"s{k}") for k in range(MOST_K + 1)]
    first = F.min(F.when(F.col("b") == 0, value)).alias("reference")
    order = F.transform(F.array_sort(F.collect_list(F.when(F.col(delta).isNotNull(), F.struct("b", F.col(delta).alias("d"))))), lambda s: s["d"])
    return rows.groupBy(*KEY, "gaggle").agg(F.max(n).alias("n"), first, F.count(delta).alias("j"), order.alias("d"), *sums)


def k_optimal(n: Column, j: Column, plain_only: bool = False) -> Column:
    """The k with the fewest bits, smallest k on ties; -1 where plain numbers aren't longer.

    plain_only leaves the k plain bits of each number out of the comparison, as
    an older coder does; its streams can be decoded all the same.
    """
    size = lambda k: F.col(f"s{k}") + (0 if plain_only else j * k) + j
    options = [F.when((n - 2 >= k) | F.lit(k == 0), F.struct(size(k).alias("bits"), F.lit(k).alias("k"))) for k in range(MOST_K + 1)]
    least = F.array_min(F.array_compact(F.array(*options)))
    return F.when(least["bits"] >= n * j, F.lit(-1)).otherwise(least["k"]).cast("int")


def k_heuristic(n: Column, j: Column) -> Column:
    """k from the sum of the numbers, without comparing sizes."""
    total = F.col("s0")
    bound = total * 128 + j * 49
    middle = B.bit_width(F.floor(bound / j).cast("bigint")) - 8
    return (
        F.when((total * 64 >= j * 23 * B.pow2(n)) | (j == 0), F.lit(-1))
        .when(j * 207 > total * 128, F.lit(0))
        .when(j * B.pow2(n + 5) <= bound, n - 2)
        .otherwise(F.greatest(middle, F.lit(0)))
        .cast("int")
    )


def chosen(rows: DataFrame, kind: str, heuristic: bool = False, plain_only: bool = False) -> DataFrame:
    """k of each gaggle. kind: dc or ac; rows as of segments.differences."""
    value = F.col("dc_q") if kind == "dc" else F.col("depth").cast("bigint")
    gaggles = _gaggles(rows, f"{kind}_delta", f"{kind}_n", value)
    n, j = F.col("n"), F.col("j")
    k = k_heuristic(n, j) if heuristic else k_optimal(n, j, plain_only)
    return gaggles.withColumn("k", F.when(n > 1, k).otherwise(F.lit(-1)))


def coded(rows: DataFrame, kind: str, heuristic: bool = False, plain_only: bool = False) -> DataFrame:
    """The bits of each gaggle, with its k. The first gaggle holds the reference after its k."""
    g = chosen(rows, kind, heuristic, plain_only)
    n, k = F.col("n"), F.col("k")
    marker = F.when(n > 1, B.bits_of(F.pmod(k, B.pow2(B.bit_width((n - 1).cast("bigint")))), B.bit_width((n - 1).cast("bigint")))).otherwise(F.lit(""))
    reference = F.when(F.col("gaggle") == 0, B.bits_of(F.col("reference"), n)).otherwise(F.lit(""))
    highs = F.array_join(F.transform("d", lambda d: F.concat(F.call_function("repeat", F.lit("0"), F.call_function("shiftright", d, F.greatest(k, F.lit(0))).cast("int")), F.lit("1"))), "")
    plain = lambda m: F.array_join(F.transform("d", lambda d: B.bits_of(d, m)), "")
    body = F.when(k < 0, plain(n)).otherwise(F.concat(highs, plain(k)))
    return g.select(*KEY, "gaggle", "n", "k", F.concat(marker, reference, body).alias("bits"))

"""Resampling of sufficient statistics: intervals over clusters, and what an instrument could detect."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio_interval(stats: DataFrame, cluster: str, num: str, den: str, rounds: int = 2000, seed: int = 11) -> DataFrame:
    """One row (value, lo, hi, p): sum(num) / sum(den) with a 95 % interval over clusters and a two-sided p.

    Each cluster enters each round a Poisson(1) number of times, drawn from (seed, cluster), so draws do not
    depend on the partitioning and no table of resamples is made: a batch returns one partial sum a round.
    Resamples in which den is 0 are left out; an empty table gives nulls.
    """

    def partial(batches):
        total = np.zeros((2, rounds))
        for pdf in batches:
            for key, n, d in zip(pdf["k"], pdf["n"], pdf["d"]):
                times = np.random.default_rng([seed, zlib.crc32(str(key).encode())]).poisson(1.0, rounds)
                total[0] += times * n
                total[1] += times * d
        yield pd.DataFrame({"round": np.arange(rounds), "n": total[0], "d": total[1]})

    rows = stats.select(F.col(cluster).cast("string").alias("k"), F.coalesce(F.col(num).cast("double"), F.lit(0.0)).alias("n"), F.coalesce(F.col(den).cast("double"), F.lit(0.0)).alias("d"))
    drawn = rows.mapInPandas(partial, "round long, n double, d double").groupBy("round").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    ratio = drawn.where("d <> 0").select((F.col("n") / F.col("d")).alias("v"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("v") <= 0).cast("double")), F.avg((F.col("v") >= 0).cast("double"))))
    spread = ratio.agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"), p.alias("p"))
    whole = rows.agg((F.sum("n") / F.nullif(F.sum("d"), F.lit(0.0))).alias("value"))
    return whole.join(F.broadcast(spread))  # one row by one row


def bleu_gap(rows: DataFrame, cluster: str, a: str, b: str, rounds: int = 1000, seed: int = 41) -> DataFrame:
    """One row (gap, lo, hi, p): corpus BLEU of arm b less that of arm a, with sentences resampled for both at once.

    a and b are columns of learning.bleu_row(). Sums are resampled as in ratio_interval().
    """
    from .learning import bleu_of, bleu_sums

    names = [f"{arm}{i}" for arm in "ab" for i in range(10)]

    def partial(batches):
        total = np.zeros((rounds, 20))
        for pdf in batches:
            for key, x, y in zip(pdf["k"], pdf["a"], pdf["b"]):
                times = np.random.default_rng([seed, zlib.crc32(str(key).encode())]).poisson(1.0, rounds)
                total += np.outer(times, np.concatenate([x, y]))
        yield pd.DataFrame(total, columns=names).assign(round=np.arange(rounds))

    flat = rows.select(F.col(cluster).cast("string").alias("k"), F.col(a).alias("a"), F.col(b).alias("b"))
    schema = ", ".join(f"{n} double" for n in names) + ", round long"
    drawn = flat.mapInPandas(partial, schema).groupBy("round").agg(*(F.sum(n).alias(n) for n in names))
    gaps = drawn.select((bleu_of("b") - bleu_of("a")).alias("v"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("v") <= 0).cast("double")), F.avg((F.col("v") >= 0).cast("double"))))
    spread = gaps.agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"), p.alias("p"))
    whole = flat.agg(*bleu_sums("a"), *bleu_sums("b")).select((bleu_of("b") - bleu_of("a")).alias("gap"))
    return whole.join(F.broadcast(spread))  # one row by one row


def power(targets: DataFrame, gaps: list[float], base: float = 0.10, miss: float = 0.30, trials: int = 200, rounds: int = 400, seed: int = 5) -> DataFrame:
    """(gap, found): the share of trials in which a planted gap between two listeners has p < 0.05.

    targets is one row (n). A target resolves to neither form with probability `miss`, alike for both
    listeners; else it drifts at `base` or `base` + gap. Targets are alike, so a resample of them is a
    multinomial draw over the nine pairs of outcomes and costs the same for any n.
    """

    def outcome(rate: float) -> np.ndarray:
        return np.array([miss, (1 - miss) * rate, (1 - miss) * (1 - rate)])

    def gap_of(cells: np.ndarray) -> np.ndarray:
        cells = cells.reshape(-1, 3, 3)
        a, b = cells.sum(2), cells.sum(1)
        rate = lambda m: m[:, 1] / np.maximum(m[:, 1] + m[:, 2], 1)
        return rate(b) - rate(a)

    def simulate(batches):
        for pdf in batches:
            found = []
            for n, gap, trial in zip(pdf["n"], pdf["gap"], pdf["trial"]):
                rng = np.random.default_rng([seed, int(round(gap * 1e6)), int(trial)])
                cells = rng.multinomial(int(n), np.outer(outcome(base), outcome(base + gap)).ravel())
                seen = gap_of(cells)[0]
                again = gap_of(rng.multinomial(int(n), cells / max(cells.sum(), 1), rounds)) if n else np.zeros(rounds)
                other = (again <= 0) if seen > 0 else (again >= 0)
                found.append(float(other.mean() < 0.05))
            yield pd.DataFrame({"gap": pdf["gap"], "found": found})

    grid = targets.select("n", F.explode(F.array(*map(F.lit, gaps))).alias("gap")).select("n", "gap", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return grid.mapInPandas(simulate, "gap double, found double").groupBy("gap").agg(F.round(F.avg("found"), 6).alias("found"))

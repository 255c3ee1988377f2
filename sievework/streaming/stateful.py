"""Keyed state over streams: budgets, running samples, suppression across sources, stalls.

State is one small row a key; Arrow batches go through applyInPandasWithState, whose state survives restarts
from the checkpoint. Inside one batch rows are taken by (ts, id), so a replay decides alike.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def within_budget(events: DataFrame, key: str, amount: str, budget: float) -> DataFrame:
    """(key, id, spent): rows in order until the next would exceed the key's budget; nothing after that, no skipping.

    events needs id and ts. A null amount counts zero.
    """

    def take(group, batches, state):
        spent, closed = state.get if state.exists else (0.0, False)
        for pdf in batches:
            out = []
            for i, v in pdf.sort_values(["ts", "id"])[["id", "amount"]].itertuples(index=False):
                v = 0.0 if pd.isna(v) else float(v)
                closed = closed or spent + v > budget
                if not closed:
                    spent += v
                    out.append((group[0], i, spent))
            yield pd.DataFrame(out, columns=["key", "id", "spent"])
        state.update((spent, closed))

    rows = events.select(F.col(key).cast("string").alias("key"), F.col("event_id").alias("id"), "ts", F.col(amount).cast("double").alias("amount"))
    return rows.groupBy("key").applyInPandasWithState(take, "key string, id long, spent double", "spent double, closed boolean", "append", GroupStateTimeout.NoTimeout)


def running_sample(events: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """(key, seen, ids): a uniform sample of at most `size` rows a key, by least hash, with the number of rows seen.

    Update mode gives the newest sample of each key. A hash order makes the sample the same for any batching.
    """

    def sample(group, batches, state):
        seen, ids = state.get if state.exists else (0, [])
        ids = set(ids)
        rank = lambda i: hashlib.md5(f"{seed}:{i}".encode()).digest()
        for pdf in batches:
            seen += len(pdf)
            ids = set(sorted(ids | set(pdf["id"].tolist()), key=rank)[:size])
        kept = sorted(ids)
        state.update((seen, kept))
        yield pd.DataFrame({"key": [group[0]], "seen": [seen], "ids": [kept]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col("event_id").alias("id"))
    return rows.groupBy("key").applyInPandasWithState(sample, "key string, seen long, ids array<long>", "seen long, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def suppressed(rows: DataFrame, key, rank: str) -> DataFrame:
    """(key, id, rank): rows whose key no source of lower rank has brought before; a source's own repeats stay.

    Within a batch lower ranks come first; what is out already is not called back. rows needs an id.
    """

    def first(group, batches, state):
        best = state.get[0] if state.exists else None
        for pdf in batches:
            out = []
            for i, r in pdf.sort_values(["rank", "id"])[["id", "rank"]].itertuples(index=False):
                best = int(r) if best is None else min(best, int(r))
                if int(r) == best:
                    out.append((group[0], i, int(r)))
            yield pd.DataFrame(out, columns=["key", "id", "rank"])
        if best is not None:
            state.update((best,))

    flat = rows.select(key.alias("key"), "id", F.col(rank).cast("long").alias("rank")).where("key IS NOT NULL AND rank IS NOT NULL")
    return flat.groupBy("key").applyInPandasWithState(first, "key string, id long, rank long", "rank long", "append", GroupStateTimeout.NoTimeout)


def stalled(polls: DataFrame, quiet: str = "30 minutes") -> DataFrame:
    """(name, polls, moved, state): polls (name, ts, counter) by tumbling window; a counter that did not move has stalled."""
    w = polls.withWatermark("ts", quiet).groupBy(F.window("ts", quiet).alias("w"), "name")
    moved = F.max("counter") - F.min("counter")
    return w.agg(F.count("*").alias("polls"), moved.alias("moved"), F.when(moved > 0, "running").otherwise("stalled").alias("state"))

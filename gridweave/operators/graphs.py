"""Connected sets of ids, and cycles of links, as joins that need few rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.kernels.labels import least_members
from gridweave.sources.tables import discarded, materialised

#: A group's links up to this number are followed in one task, with the same result.
SMALL = 1 << 17


def least_ids(links: DataFrame, small: int = SMALL) -> DataFrame:
    """scene, id, least: of every end of links (scene, a, b: long), the least id that links lead to.

    Every round each id moves to that of its neighbours, or itself, that is first in an order drawn
    anew for the round; links between what moved together vanish. A chain, whatever its ids, loses
    half of them a round, so the rounds grow with the logarithm of the longest chain. The least
    id of each set is looked up at the end.
    """
    links = materialised(links.filter("a <> b").select("scene", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if links.count() <= small:
        kinds = dict(links.dtypes)

        def follow(rows: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(rows[["a", "b"]].to_numpy(), return_inverse=True)
            at = at.reshape(-1, 2)
            return pd.DataFrame({"scene": rows["scene"].iloc[0], "id": ids, "least": ids[least_members(at[:, 0], at[:, 1], len(ids))]})

        out = materialised(links.groupBy("scene").applyInPandas(follow, f"scene {kinds['scene']}, id long, least long"))
        discarded(links)
        return out
    moved = materialised(links.select("scene", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("to", F.col("id")))
    turn = 0
    while not links.isEmpty():
        turn += 1
        drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("place"), F.col(c).alias("id"))  # noqa: B023, E731
        both = links.select("scene", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("scene", "e.*")
        steps = materialised(both.groupBy("scene", "v").agg(F.min(drawn("w")).alias("w")).select("scene", "v", F.least(drawn("v"), F.col("w"))["id"].alias("next")))
        side = lambda c: steps.select("scene", F.col("v").alias(c), F.col("next").alias(f"next_{c}"))  # noqa: B023, E731
        after = links.join(side("a"), ["scene", "a"]).join(side("b"), ["scene", "b"]).filter("next_a <> next_b")
        after = materialised(after.select("scene", F.least("next_a", "next_b").alias("a"), F.greatest("next_a", "next_b").alias("b")).distinct())
        further = materialised(moved.join(side("to"), ["scene", "to"], "left").select("scene", "id", F.coalesce("next_to", "to").alias("to")))
        for old in (links, moved, steps):
            discarded(old)
        links, moved = after, further
    least = moved.groupBy("scene", "to").agg(F.min("id").alias("least"))
    out = materialised(moved.join(least, ["scene", "to"]).select("scene", "id", "least"))
    discarded(links)
    discarded(moved)
    return out


def ordered_cycles(links: DataFrame) -> DataFrame:
    """scene, id, cycle, off from links (scene, id, next: long), in which each id is the next of exactly one: the least id of its cycle, and how many steps on that is.

    Every round each id looks twice as far ahead: it keeps the least id within reach and the steps to it. A round that
    changes no least id is the last.
    """
    state = materialised(links.select("scene", "id", "next", F.col("id").alias("cycle"), F.lit(0).cast("long").alias("off")))
    reach = 1
    while True:
        ahead = state.select("scene", F.col("id").alias("next"), F.col("next").alias("then"), F.col("cycle").alias("there"), (F.col("off") + reach).alias("later"))
        lower = F.col("there") < F.col("cycle")
        after = state.join(ahead, ["scene", "next"]).select("scene", "id", F.col("then").alias("next"), F.least("there", "cycle").alias("cycle"), F.when(lower, F.col("later")).otherwise(F.col("off")).alias("off"), lower.alias("changed"))
        after = materialised(after)
        discarded(state)
        state, reach = after.drop("changed"), reach * 2
        state._gridweave_path = after._gridweave_path
        if after.filter("changed").isEmpty():
            return state.drop("next")

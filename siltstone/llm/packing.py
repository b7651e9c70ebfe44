"""Filling containers of fixed capacity, by hierarchical residual packing.

Every part of the data packs its own items by best fit, largest first. Nearly full containers
are done. The others become items themselves, meet those of other parts in fewer parts, and
are packed again, level by level, until no level saves containers any more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Items that one task packs at once.
PART = 20_000
#: A container this full is done.
FULL = 0.995

BINS = "bin string, fill long, members array<struct<id:long,piece:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes by container. sizes descend; each goes where it leaves the least room.

    `free` holds a bit for every amount of room that some open container has.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    free = 0
    for i, size in enumerate(sizes):
        above = free >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                free ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            by_room.setdefault(left, []).append(b)
            free |= 1 << left
    return bins


def _level(capacity: int, level: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        sizes, names, members = part["fill"].tolist(), part["bin"].tolist(), part["members"].tolist()
        out = [(names[b[0]], sum(sizes[i] for i in b), [m for i in b for m in members[i]]) for b in best_fit(sizes, capacity)]
        return pd.DataFrame(out, columns=["bin", "fill", "members"])

    return run


def pack(items: DataFrame, capacity: int, part: int = PART, full: float = FULL) -> DataFrame:
    """(container string, id, piece int, pieces int, start bigint, size bigint) from items (id bigint, size bigint).

    Items without a size, of size 0 or less and with a null id are left out. Only an item
    larger than the capacity is split: into pieces of exactly the capacity and a rest. ids must
    be unique; rows that repeat an id with the same size are taken as one item. The same items
    give the same containers however the table is partitioned. A container is named after the
    largest piece in it, so names are unique.
    """
    whole = items.where(F.col("id").isNotNull() & (F.col("size") > 0)).groupBy("id").agg(F.max("size").alias("size"))
    pieces = materialize(
        whole.select("id", "size", F.ceil(F.col("size") / capacity).cast("int").alias("pieces"))
        .select("id", "size", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        .select("id", "piece", "pieces", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece").cast("long") * capacity).alias("fill")),
        "pieces",
    )
    bins = pieces.select(F.concat_ws("-", "id", "piece").alias("bin"), "fill", F.array(F.struct("id", "piece")).alias("members"))
    done: list[DataFrame] = []
    level = 0
    there = bins.count()
    while there:
        parts = max(1, -(-there // part))
        key = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(parts)).alias("part")
        packed = materialize(bins.select("*", key).groupBy("part").applyInPandas(_level(capacity, level), BINS), "bins")
        done.append(packed.where(F.col("fill") >= full * capacity))
        bins = packed.where(F.col("fill") < full * capacity)
        saved = there - packed.count()
        there, level = bins.count(), level + 1
        # One part has met itself whole; a level of several that saved nothing would be the last one, too.
        if parts == 1 or not saved:
            break
    done.append(bins)
    held = done[0]
    for x in done[1:]:
        held = held.unionByName(x)
    held = held.select(F.col("bin").alias("container"), F.explode("members").alias("m")).select("container", "m.id", "m.piece")
    return held.join(pieces, ["id", "piece"]).select("container", "id", "piece", "pieces", "start", F.col("fill").alias("size"))

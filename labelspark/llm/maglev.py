"""Sharding by a permutation-filled lookup table of prime size."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table, a prime; over a hundred per shard keep shards within about one percent.
TABLE_SIZE = 65537


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> np.ndarray:
    """Shard number of each slot.

    Each shard has a permutation of the slots (an offset and a step, by hashes of its name).
    Shards take turns; in its turn a shard claims the first slot of its permutation that is
    still free. Adding or removing a shard moves few slots of the others.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards need distinct names, at least one and at most one per slot")
    if any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size has to be a prime")
    offset = [xxhash.xxh3_64_intdigest(s.encode(), seed=1) % size for s in shards]
    step = [xxhash.xxh3_64_intdigest(s.encode(), seed=2) % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, dtype=np.int32)
    at, filled = list(offset), 0
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step[i]) % size
            table[slot] = i
            at[i] = (slot + step[i]) % size
            filled += 1
            if filled == size:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def assign_shards(docs: DataFrame, shards: tuple[str, ...], size: int = TABLE_SIZE) -> DataFrame:
    """One row per row of `docs` (doc_id): doc_id, slot, shard.

    Placement is by doc_id alone, so repeated rows go together, whatever a source's share; a
    null doc_id has a slot like any other key. Texts are not read; an empty table gives an
    empty result. The broadcast has `size` rows, whatever the input.
    """
    spark = docs.sparkSession
    table = [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, size).tolist())]
    lookup = spark.createDataFrame(table, "slot int, shard string")
    placed = docs.select("doc_id", slot_of(F.col("doc_id"), size).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: tuple[str, ...], size: int = TABLE_SIZE) -> None:
    """Write `docs` with all columns into one folder a shard.

    Rows go to (shard, salt) tasks, so a shard's size is not a task's.
    """
    table = F.broadcast(
        docs.sparkSession.createDataFrame(
            [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, size).tolist())], "_slot int, _shard string"
        )
    )
    placed = docs.withColumn("_slot", slot_of(F.col("doc_id"), size)).join(table, "_slot")
    spread = placed.repartition("_shard", F.pmod(F.col("_slot"), F.lit(16))).drop("_slot")
    spread.write.partitionBy("_shard").parquet(path)

"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: an
offset and a step from hashes of its name, which visit every slot once. The
shards take turns; at its turn a shard claims the first slot in its order that
is still free. The filled table is balanced to one slot in size, and a shard
that leaves moves few other keys. A key's slot is its hash modulo the size, so
placement is one lookup in a broadcast table of a fixed size.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; the broadcast table has this many rows whatever the data.
SLOTS = 65_537
#: Largest table that is broadcast: 12 bytes a row.
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard's number for each slot. Shards are taken in the order given; names must differ."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most one a slot")
    at = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return np.array(table, dtype=np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its text's MD5 modulo the size; null keys share the slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    filled = fill_table(shards, slots)
    rows = list(zip(range(slots), filled.tolist(), strict=True))
    return spark.createDataFrame(rows, "table_slot int, table_shard int")


def assign_shards(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with shard (int) and slot (int), without a shuffle.

    Equal keys, null included, get the same shard; repeated rows stay. Columns of
    ``docs`` named shard, slot, table_slot or table_shard, in any case, are replaced. An empty
    table gives an empty result.
    """
    slot = slot_of(F.col(key_col), slots)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot", "table_slot", "table_shard")]
    table = table_frame(docs.sparkSession, shards, slots)
    return docs.select(*rest, slot.alias("slot")).join(F.broadcast(table), F.col("slot") == F.col("table_slot")).drop("table_slot").withColumnRenamed("table_shard", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], key_col: str = "doc_id", files_per_shard: int = 4) -> None:
    """Parquet folders shard=N; a second hash spreads each shard over some files, so no shard is one task."""
    placed = assign_shards(docs, shards, key_col)
    part = F.pmod(F.xxhash64(F.col(key_col).cast("string"), F.lit(1)), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)

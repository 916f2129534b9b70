"""Sharding by a permutation-filled lookup table (Maglev hashing).

Every shard has its own permutation of the slots of a prime-sized table. The shards take turns; in
its turn a shard claims the first slot of its permutation that is still free. A row's key hashes to a
slot and the slot names the shard, so placement is one lookup, loads differ by at most one slot, and
adding or removing a shard moves few keys.

Edge cases: a null key hashes like any other value, so all rows with null keys share one shard unless
``spread_by`` is given; repeated rows go to the same shard; an empty table stays empty; other columns
pass through untouched, and the new columns may not clash with them (``ValueError``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast; 2 bytes a slot, so at most 2 MiB.
MAX_SLOTS = 1 << 20


def _digest(name: str, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(names: Sequence[str], size: int = 65537, weights: Sequence[int] | None = None) -> list[int]:
    """Index of the shard that owns each of ``size`` slots.

    ``weights[i]`` is the number of slots that shard ``i`` claims in each round (1 by default).
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and not empty")
    if not is_prime(size) or size < len(names) or size > MAX_SLOTS or len(names) > 65535:
        raise ValueError("the table size must be a prime, no less than the number of shards, within MAX_SLOTS")
    turns = list(weights) if weights is not None else [1] * len(names)
    if len(turns) != len(names) or min(turns) < 0 or not sum(turns):
        raise ValueError("one weight of at least 0 for each shard, not all 0")
    at = [_digest(n, "offset") % size for n in names]
    step = [_digest(n, "skip") % (size - 1) + 1 for n in names]
    owner, free = [-1] * size, size
    while True:
        for shard, turn in enumerate(turns):
            for _ in range(turn):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % size
                owner[at[shard]] = shard
                free -= 1
                if not free:
                    return owner


def table_frame(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """The lookup table as rows (slot, shard), decoded from one packed literal."""
    packed = b"".join(x.to_bytes(2, "big") for x in owner).hex()
    return spark.range(0, len(owner), 1, 1).select(
        F.col("id").alias("slot"),
        F.conv(F.hex(F.expr(f"substring(X'{packed}', cast(2 * id + 1 as int), 2)")), 16, 10).cast("int").alias("shard"),
    )


def slot_of(keys: Sequence[Column], size: int, spread_by: Sequence[Column] = (), spread: int = 1) -> Column:
    """Slot of a key. With ``spread`` > 1, rows of one key go to that many neighbouring slots."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(size))
    if spread > 1 and spread_by:
        slot = F.pmod(slot + F.pmod(F.xxhash64(*spread_by), F.lit(spread)), F.lit(size))
    return slot


def assign_shards(
    df: DataFrame,
    keys: Sequence[str],
    shards: int | Sequence[str],
    size: int = 65537,
    weights: Sequence[int] | None = None,
    spread_by: Sequence[str] = (),
    spread: int = 1,
) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (int).

    The table is broadcast; its size is bounded by ``MAX_SLOTS``, whatever the input. No row moves.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if clash := {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    lookup = table_frame(df.sparkSession, fill_table(names, size, weights))
    slot = slot_of([F.col(f"`{k}`") for k in keys], size, [F.col(f"`{k}`") for k in spread_by], spread)
    return df.withColumn("slot", slot).join(F.broadcast(lookup), "slot", "left").select(*[f"`{c}`" for c in df.columns], "slot", "shard")


def write_shards(df: DataFrame, path: str, keys: Sequence[str], shards: int | Sequence[str], files_per_shard: int = 1, **options) -> None:
    """Write one folder for each shard. Within a shard rows are dealt over ``files_per_shard`` tasks by
    all their columns' hash, so that a hot key doesn't make one task write a third of the rows."""
    placed = assign_shards(df, keys, shards, **options)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)

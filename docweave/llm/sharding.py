"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table whose size is a prime: offset, offset + skip, offset + 2 * skip ... A
prime makes each order visit every slot. Shards take turns, each claiming the first slot of its order that is still free,
until the table is full; so their shares differ by one slot at most, and when a shard comes or goes few other slots change hands. A
key's slot is its hash modulo the size. The table's size is a parameter, whatever the input, and so is safe to broadcast.

Defined results: a null key is hashed as Spark hashes null and placed like any other; repeated rows are placed alike; other columns
pass through, but for slot and shard, which are replaced (either may be the key); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, MOST = 65_537, 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names")
    if not is_prime(size) or not len(shards) <= size <= MOST:
        raise ValueError(f"the size must be a prime, as large as the number of shards and at most {MOST}")
    hashed = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(h[:8], "big") % size for h in hashed]
    skip = [int.from_bytes(h[8:16], "big") % (size - 1) + 1 for h in hashed]
    owner, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def place(rows: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """rows with slot and shard."""
    import pyarrow as pa

    owner = lookup_table(shards, size)
    slots = rows.sparkSession.createDataFrame(pa.table({"slot": pa.array(range(size), pa.int32()), "shard": [shards[i] for i in owner]}))
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("slot", "shard")]
    # The key may be a column of one of these names.
    keyed = rows.select(*rest, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(size)).cast("int").alias("slot"))
    return keyed.join(F.broadcast(slots), "slot").select(*rest, "slot", "shard")

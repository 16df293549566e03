"""Surrogate keys: random, independent of the values they stand for, unique.

Keys come from the operating system's random source, so they can't be worked out from a value or its place. They are
written before they are used: a lazy random column gives other keys each time it is read.
"""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.tables import store
from ..types import KeySpaceExhaustedError

#: The alphabet and the length of a key's random part, and the attempts at a free key.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
LENGTH = 9
ATTEMPTS = 10_000


@F.pandas_udf(StringType())
def _random(prefix: pd.Series) -> pd.Series:
    return prefix.map(lambda p: f"{p}_" + "".join(secrets.choice(ALPHABET) for _ in range(LENGTH)))


random_key = _random.asNondeterministic()


def with_keys(new: DataFrame, taken: DataFrame, prefix, key: str, make=random_key, attempts: int = ATTEMPTS) -> DataFrame:
    """``new`` with a column ``key``: a fresh key for each row, none equal to another or to one in ``taken`` (a column ``key``).

    ``prefix`` is an expression over ``new``. Rows whose key isn't free get another, up to ``attempts`` times. The result is
    written, so every use sees the same keys.
    """
    done = None
    todo = store(new.withColumn("_prefix", prefix).withColumn(key, make(F.col("_prefix"))), "keys")
    for _ in range(attempts):
        held = taken.select(key) if done is None else taken.select(key).union(done.select(key))
        # Keys that came up twice, or that are in use; nearly always there are none, and then nothing is written again.
        clash = todo.groupBy(key).count().where("count > 1").select(key).union(todo.join(held, key, "left_semi").select(key)).distinct()
        if clash.isEmpty():
            return (todo if done is None else done.unionByName(todo)).drop("_prefix")
        rest = [c for c in todo.columns if c != key]
        # Of equal new keys the row with the least contents keeps it.
        keepers = todo.groupBy(key).agg(F.min(F.struct(*rest)).alias("_kept")).join(held, key, "left_anti").select("_kept.*", key)
        done = store(keepers if done is None else done.unionByName(keepers), "keys")
        old = done.select(*[F.col(c).alias(f"d_{c}") for c in rest])
        left = todo.join(old, [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in rest], "left_anti")
        todo = store(left.withColumn(key, make(F.col("_prefix"))), "keys")
    raise KeySpaceExhaustedError("key_space_exhausted")

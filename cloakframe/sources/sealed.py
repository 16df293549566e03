"""String columns encrypted where tables are written, and opened where they are read.

Each value is sealed by AES-GCM under a nonce of its own. The key goes in as a column of a one-row table, not as a literal, so
plans and event logs don't show it. Scratch tables are sealed with a key that only the driver's memory holds: what a job leaves
behind can't be read once its driver has ended.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: The key of this process's scratch tables.
SCRATCH_KEY = secrets.token_bytes(32)
_KEY = "_sealing_key"


def _with_key(df: DataFrame, key: bytes) -> DataFrame:
    """Each row with the key; the other side is one row."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(bytearray(key),)], f"{_KEY} binary")))


def sealed_schema(schema: StructType) -> StructType:
    """A schema as it is written: strings are bytes."""
    return StructType([StructField(f.name, BinaryType() if isinstance(f.dataType, StringType) else f.dataType, True) for f in schema.fields])


def _texts(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, StringType)]


def seal(df: DataFrame, key: bytes) -> DataFrame:
    """The table with its string columns encrypted; nulls stay null."""
    texts = _texts(df.schema)
    if not texts:
        return df
    return _with_key(df, key).select(*[F.expr(f"aes_encrypt(cast(`{c}` as binary), {_KEY}, 'GCM')").alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def unseal(df: DataFrame, schema: StructType, key: bytes) -> DataFrame:
    """The inverse of ``seal``; ``schema`` is that of the open table."""
    texts = _texts(schema)
    if not texts:
        return df
    return _with_key(df, key).select(*[F.expr(f"cast(aes_decrypt(`{c}`, {_KEY}, 'GCM') as string)").alias(c) if c in texts else F.col(f"`{c}`") for c in schema.names])

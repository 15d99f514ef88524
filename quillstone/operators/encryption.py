"""Encrypted rows: AES-256 in Galois counter mode by the built-in functions, keys derived from a password.

The columns that aren't kept in the clear become one binary column: a fresh nonce, the encrypted JSON of the row, and a tag
that also covers the name of the collection, so a row moved to another collection or changed fails to open. Keys are
literals of the plan: whoever may see a session's plans may see them.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BYTES, ROUNDS = 32, 600_000


def key_of(password: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    """PBKDF2 with SHA-256."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, KEY_BYTES)


def expand(master: bytes, info: bytes, salt: bytes = b"", size: int = KEY_BYTES) -> bytes:
    """HKDF with SHA-256: a key for one purpose (`info`) from a master key."""
    own = hmac.new(salt or bytes(32), master, "sha256").digest()
    out, block = b"", b""
    for k in range(1, -(-size // 32) + 1):
        block = hmac.new(own, block + info + bytes([k]), "sha256").digest()
        out += block
    return out[:size]


def _checked(key: bytes) -> Column:
    if len(key) != KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes")
    return F.lit(key)


def seal(df: DataFrame, key: bytes, collection: str, keep: Sequence[str] = (), name: str = "sealed") -> DataFrame:
    """df with the columns in `keep` and one binary column of all others."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keep]
    row = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return df.select(*keep, F.aes_encrypt(F.encode(row, "utf-8"), _checked(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(collection.encode())).alias(name))


def unseal(df: DataFrame, key: bytes, collection: str, schema: T.StructType | str, name: str = "sealed") -> DataFrame:
    """The rows again; schema: of the sealed columns. A wrong key, or rows that were changed or moved, fail."""
    row = F.decode(F.aes_decrypt(F.col(name), _checked(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(collection.encode())), "utf-8")
    return df.withColumn(name, F.from_json(row, schema, {"mode": "FAILFAST"})).select(*(c for c in df.columns if c != name), f"{name}.*")

"""Keyed lookups and sealed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def keyed_index(value: Column, key: bytes) -> Column:
    """K1: HMAC-SHA-256 in hex, from two digests with constant pads, so sealed keys can still be joined on."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    padded = key.ljust(BLOCK, b"\0")
    inner_pad = F.unhex(F.lit(bytes(b ^ 0x36 for b in padded).hex()))
    outer_pad = F.unhex(F.lit(bytes(b ^ 0x5C for b in padded).hex()))
    inner = F.unhex(F.sha2(F.concat(inner_pad, value.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def seal(row: Column, key: bytes) -> Column:
    """K2: a struct as authenticated ciphertext."""
    return F.aes_encrypt(F.to_json(row), F.lit(key), F.lit("GCM"))


def unseal(sealed: Column, key: bytes, schema: str) -> Column:
    """K2: the struct back, or null when the bytes were changed."""
    return F.from_json(F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM")).cast("string"), schema)


def key_hash(field: Column, value: Column, salt: str) -> Column:
    """Q7: salted digest of a patient key, so keys are compared without being shown."""
    return F.sha2(F.concat(F.lit(salt), F.lit("|"), field, F.lit("|"), value), 256)


def allow_listed(fields: DataFrame, catalog: DataFrame, name: str = "field") -> DataFrame:
    """K3: only rows whose field is in the catalog."""
    allowed = F.broadcast(catalog.select(F.col("field").alias("_allowed")))  # tens of rows
    return fields.join(allowed, fields[name] == F.col("_allowed"), "left_semi")


def rejected_fields(fields: DataFrame, catalog: DataFrame, name: str = "field") -> DataFrame:
    """K3: how many values were refused per unknown field."""
    allowed = F.broadcast(catalog.select(F.col("field").alias("_allowed")))
    return (fields.join(allowed, fields[name] == F.col("_allowed"), "left_anti")
            .groupBy(name).agg(F.count(F.lit(1)).alias("rejected")))

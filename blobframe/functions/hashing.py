"""Hashes, ids and ring positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def ring_position(key: Column) -> Column:
    """First 32 bits of the SHA-1 of the key's text, as a number."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint")


def hash_byte(key: Column, at: int) -> Column:
    """Byte `at` of the key's SHA-1: a reproducible stand-in for chance."""
    return F.conv(F.substring(F.sha1(key), 2 * at + 1, 2), 16, 10).cast("int")


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer block of HMAC-SHA-256 for a secret."""
    import hashlib

    raw = secret.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256_hex(message: Column, secret: str) -> Column:
    """HMAC composed of two SHA-256 and literal pads, so that it stays in generated code."""
    inner, outer = (F.lit(bytearray(p)) for p in hmac_pads(secret))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def is_chunk_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def chunk_path(value: Column) -> Column:
    """Two levels of directories by the first bytes of the hash; null where the hash is malformed."""
    path = F.concat_ws("/", F.substring(value, 1, 2), F.substring(value, 3, 2), value)
    return F.when(is_chunk_hash(value), path)


def deterministic_id(prefix: str, *key: Column) -> Column:
    """prefix and 24 hex digits of the key's hash: ids that a repeated task makes alike."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("/", *key), 256), 1, 24))

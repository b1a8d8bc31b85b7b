"""Time-limited URLs: signing, and the ladder of checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEV_SECRET, PRESIGN_TTL_SECONDS
from .hashing import hmac_sha256_hex


_NUMBER = r"\A[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\z"


def payload(method: Column, path: Column, expires_ms: Column) -> Column:
    return F.concat_ws(":", method, path, expires_ms.cast("string"))


def presign(method: Column, path: Column, now_ms: Column, ttl_seconds: int = PRESIGN_TTL_SECONDS, secret: str = DEV_SECRET) -> Column:
    """struct(url, expires_at, signature)."""
    expires = now_ms.cast("bigint") + F.lit(ttl_seconds * 1000)
    signature = hmac_sha256_hex(payload(method, path, expires), secret)
    url = F.concat(path, F.lit("?expires="), expires.cast("string"), F.lit("&sig="), signature)
    return F.struct(url.alias("url"), expires.alias("expires_at"), signature.alias("signature"))


def verify(method: Column, path: Column, expires: Column, signature: Column, now_ms: Column, secret: str = DEV_SECRET) -> Column:
    """'ok', or the first check that fails: missing, malformed, expired (a moment after the expiry, not at it), tampered. The
    payload is rebuilt from the number that `expires` spells, in decimal digits, with an exponent or as Infinity, blanks around it
    aside; only whole numbers are ever signed, so any other is tampered. No input raises. Hex digits of the signature count in
    either case."""
    spelled = F.trim(expires)
    number = F.when(spelled.rlike(_NUMBER), spelled.try_cast("double"))
    exact = (F.abs(number) <= F.lit(float(1 << 53))) & (number == F.floor(F.when(F.abs(number) <= F.lit(float(1 << 53)), number)))
    whole = F.when(exact, number).try_cast("bigint")
    expected = hmac_sha256_hex(payload(method, path, whole), secret)
    missing = expires.isNull() | (expires == "") | signature.isNull() | (signature == "")
    return (
        F.when(missing, F.lit("missing"))
        .when(number.isNull(), F.lit("malformed"))
        .when(now_ms > number, F.lit("expired"))
        .when(whole.isNull() | (F.lower(signature) != expected), F.lit("tampered"))
        .otherwise(F.lit("ok"))
    )

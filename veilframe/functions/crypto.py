"""Digests and sealed values, natively: HMAC and HKDF from sha2, AES-256-GCM with the owner as associated data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(value: Column | str | bytes) -> Column:
    if isinstance(value, bytes):
        return F.unhex(F.lit(value.hex()))
    return F.lit(value).cast("binary") if isinstance(value, str) else value.cast("binary")


def _xored(key: bytes, pad: int) -> bytes:
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    return bytes(b ^ pad for b in key.ljust(64, b"\0"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """32 bytes; key is a constant of the job."""
    inner = F.unhex(F.sha2(F.concat(_bytes(_xored(key, 0x36)), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(_bytes(_xored(key, 0x5C)), inner), 256))


def framed(value: Column) -> Column:
    """Four bytes of length, then the value."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 8, "0")), value)


def bound_info(info: str, owner: Column) -> Column:
    return F.concat(framed(_bytes(info)), framed(_bytes(owner)))


def derive_key(pepper: bytes, info: Column) -> Column:
    """HKDF-SHA256 with an empty salt, one block; the info differs from row to row."""
    import hashlib
    import hmac

    prk = hmac.new(bytes(32), pepper, hashlib.sha256).digest()
    return hmac_sha256(prk, F.concat(info, F.unhex(F.lit("01"))))


def seal(value: Column, owner: Column, pepper: bytes, info: str) -> Column:
    """nonce, ciphertext and tag; the nonce is random for every row."""
    return F.aes_encrypt(value.cast("binary"), derive_key(pepper, bound_info(info, owner)), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")), owner.cast("binary"))


def unseal(sealed: Column, owner: Column, pepper: bytes, info: str) -> Column:
    """The value, or null for another owner, key or an altered ciphertext."""
    return F.try_aes_decrypt(sealed, derive_key(pepper, bound_info(info, owner)), F.lit("GCM"), F.lit("DEFAULT"), owner.cast("binary"))


def request_mac(key: bytes, method: Column, user: Column, at: Column, params: Column) -> Column:
    """Hex MAC of method, user, time and the parameters (a map) with their keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.lower(F.hex(hmac_sha256(key, F.concat_ws(":", method, user, at.cast("string"), F.to_json(ordered)))))


def request_ok(key: bytes, method: Column, user: Column, at: Column, params: Column, signature: Column, now: Column, window: int = 5) -> Column:
    """Is the signature right and the time within the window?"""
    return (F.abs(now - at) <= window) & (request_mac(key, method, user, at, params) == signature)

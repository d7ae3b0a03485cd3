"""Keys and tweaks for format-preserving encryption; all of it stays on the driver."""

from __future__ import annotations

import hashlib
import hmac

KEY_BYTES, TWEAK_BYTES = 32, 7


def _bytes(value: bytes, n: int, what: str) -> bytes:
    if not isinstance(value, (bytes, bytearray)):
        raise TypeError(f"{what} must be bytes, not {type(value).__name__}")
    if len(value) != n:
        raise ValueError(f"{what} must be exactly {n} bytes, not {len(value)}")
    return bytes(value)


def validate_key(key: bytes) -> bytes:
    key = _bytes(key, KEY_BYTES, "key")
    if key == key[:1] * KEY_BYTES:
        raise ValueError("key must not be one byte repeated")
    return key


def validate_tweak(tweak: bytes) -> bytes:
    return _bytes(tweak, TWEAK_BYTES, "tweak")


def _context(master: bytes, context: str) -> bytes:
    if type(master) not in (bytes, bytearray):
        raise TypeError("the master secret must be bytes")
    return context.encode()


def hkdf(master: bytes, salt: bytes, info: bytes, n: int = KEY_BYTES) -> bytes:
    """HKDF with SHA-256, as in RFC 5869; an empty salt is that of none."""
    prk = hmac.new(salt or bytes(32), master, hashlib.sha256).digest()
    out = block = b""
    for k in range(1, -(-n // 32) + 1):
        block = hmac.new(prk, block + info + bytes([k]), hashlib.sha256).digest()
        out += block
    return out[:n]


def derive_key(master: bytes, context: str, salt: bytes = b"") -> bytes:
    """HKDF-SHA256 of the master secret for a context such as a column's name. Keys that another program derived with
    a salt of its own are derived again with that salt."""
    return hkdf(master, salt, b"key:" + _context(master, context))


def derive_tweak(master: bytes | bytearray, context: str) -> bytes:
    return hmac.new(master, b"tweak:" + _context(master, context), hashlib.sha256).digest()[:TWEAK_BYTES]

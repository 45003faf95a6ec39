"""Digests and keyed digests, all on the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def masked(c: Column) -> Column:
    """``sha256:`` and the first sixteen hex digits."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(c, 256), F.lit(16)))


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of an HMAC-SHA-256 key of at least 256 bits."""
    if len(key) < 32:
        raise ValueError("The pseudonymisation key must contain at least 256 bits.")
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def keyed_digest(key: bytes, c: Column) -> Column:
    """HMAC-SHA-256 of a text column as two nested SHA-256 digests; null stays null."""
    inner, outer = key_pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), c.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def subject_digest(key: bytes, scope: Column, subject: Column) -> Column:
    """Pseudonym of a subject inside a scope."""
    return keyed_digest(key, F.concat(F.lit("subject\n"), scope, F.lit("\n"), subject))


def request_digest(key: bytes, request: Column) -> Column:
    return keyed_digest(key, F.concat(F.lit("request\n"), request))

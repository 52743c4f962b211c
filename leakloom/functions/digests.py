"""Digest expressions for addresses and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leakloom.functions.catalog import KEY_PREFIX_CHARS, UNSALTED_ADDRESS


def address_pseudonym(address: Column, pepper: str | None) -> Column:
    """First 16 hex digits of a peppered digest; a constant when there is no pepper."""
    if not pepper:
        return F.lit(UNSALTED_ADDRESS)
    return F.left(F.sha2(F.concat(F.lit(pepper + ":"), address), 256), F.lit(16))


def key_digest(key: Column) -> Column:
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    return F.left(key, F.lit(KEY_PREFIX_CHARS))

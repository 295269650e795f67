"""Seeded draws that do not depend on partitioning or on an engine's generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts) -> Column:
    """md5 hex text over the parts joined by a bar."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def digest_number(hex_text: Column, slot: int = 0) -> Column:
    """One of the four 32-bit numbers held by a 32-digit hex text."""
    piece = F.substring(hex_text, slot * 8 + 1, 8)
    return F.conv(piece, 16, 10).cast("long")


def draw(modulus, *parts) -> Column:
    """Integer in ``[0, modulus)`` decided by the parts alone."""
    modulus = modulus if isinstance(modulus, Column) else F.lit(modulus)
    return F.pmod(digest_number(digest(*parts)), modulus.cast("long"))


def unit_draw(*parts) -> Column:
    """Number in ``[0, 1)`` decided by the parts alone."""
    return digest_number(digest(*parts)) / F.lit(4294967296.0)

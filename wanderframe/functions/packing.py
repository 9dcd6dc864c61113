"""The packed 64-bit form of a walk: source 24 bits, in-block offset 26 bits, hop 14 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_BITS, OFFSET_BITS, HOP_BITS = 24, 26, 14


def encode(source: Column, offset: Column, hop: Column) -> Column:
    """Values that do not fit their bits give null rather than an alias of another walk."""
    fits = (source >= 0) & (source < 1 << SOURCE_BITS) & (offset >= 0) & (offset < 1 << OFFSET_BITS) & (hop >= 0) & (hop < 1 << HOP_BITS)
    packed = F.shiftleft(source.cast("long"), OFFSET_BITS + HOP_BITS).bitwiseOR(F.shiftleft(offset.cast("long"), HOP_BITS)).bitwiseOR(hop.cast("long"))
    return F.when(fits, packed)


def source_of(walk: Column) -> Column:
    return F.shiftrightunsigned(walk, OFFSET_BITS + HOP_BITS)


def offset_of(walk: Column) -> Column:
    return F.shiftright(walk, HOP_BITS).bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


def hop_of(walk: Column) -> Column:
    return walk.bitwiseAND(F.lit((1 << HOP_BITS) - 1))

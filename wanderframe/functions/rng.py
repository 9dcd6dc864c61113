"""Randomness that is a function of walk, hop and purpose: equal on every engine, partitioning and retry.

Each function has a twin that gives the same expression as SQL text. All arithmetic stays within 63 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
MULTIPLIER = 73244475
#: What a draw is for.
CONTINUE, NEIGHBOUR, JUMP, SEEDING = range(4)
#: A walk goes on where its draw exceeds 0.15 of the range.
STOP_BELOW = 644245094


def mix32(x: Column) -> Column:
    """A 32-bit hash of a 32-bit value."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * MULTIPLIER).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def draw(walk_id: Column, hop: Column | int, purpose: int, seed: int) -> Column:
    """A number in [0, 2**32) for this walk, hop and purpose. walk_id stays below about 9e12."""
    hop = F.lit(hop) if isinstance(hop, int) else hop
    mixed = walk_id.cast("long") * 1000003 + hop.cast("long") * 7919 + F.lit(purpose * 104729 + seed).cast("long")
    return mix32(mixed.bitwiseAND(F.lit(MASK)))


def mix32_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {MULTIPLIER}) & {MASK})"
    return f"xor({x}, ({x}) >> 16)"


def draw_sql(walk_id: str, hop: int | str, purpose: int, seed: int) -> str:
    return mix32_sql(f"((({walk_id})::BIGINT * 1000003 + ({hop})::BIGINT * 7919 + {purpose * 104729 + seed}) & {MASK})")

"""Step rules. A kernel says when a walk follows an edge and what it does otherwise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kernel:
    """otherwise(source, jump target) is the next vertex of a walk that follows no edge; None ends the walk.

    otherwise_sql names the same for SQL and for resident walks: "source", "target", or None where a kernel of one's own
    does something else or ends the walk.
    damped: an edge is followed only where the walk's draw says so, else wherever there is one.
    visits(length): how many positions a walk of that length records; None for no limit.
    """

    name: str
    otherwise: Callable[[Column, Column], Column] | None
    otherwise_sql: str | None
    damped: bool = True
    visits: Callable[[int], int | None] = lambda length: length

    @property
    def resident(self) -> bool:
        """Whether otherwise is one of those that walks over a resident adjacency know; others step by joins."""
        return self.otherwise is None or self.otherwise_sql in ("source", "target")


jump = Kernel("jump", lambda source, target: target, "target")
stop = Kernel("stop", None, None)
prob = Kernel("prob", None, None, visits=lambda length: None)
restart = Kernel("restart", lambda source, target: source, "source")
restart_joint = Kernel("restart_joint", lambda source, target: source, "source", visits=lambda length: max(1, length - 1))
simple = Kernel("simple", None, None, damped=False)

KERNELS = {k.name: k for k in (jump, stop, prob, restart, restart_joint, simple)}


def ended() -> Column:
    return F.lit(None).cast("long")

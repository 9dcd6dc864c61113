"""Options of a job: a key=value file, overridden by the command line, typed by a dataclass."""

from __future__ import annotations

import dataclasses
from typing import TypeVar

T = TypeVar("T")


def read_config(text: str) -> dict[str, str]:
    """key = value lines; # begins a comment. A line without = is an error."""
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if line:
            key, eq, value = line.partition("=")
            if not eq:
                raise ValueError(f"line {number}: no = in {line!r}")
            out[key.strip()] = value.strip()
    return out


def read_arguments(args: list[str]) -> dict[str, str]:
    """--key=value, --key value and key value."""
    out, rest = {}, list(args)
    while rest:
        word = rest.pop(0).removeprefix("--")
        key, eq, value = word.partition("=")
        if not eq and not rest:
            raise ValueError(f"no value for {key}")
        out[key] = value if eq else rest.pop(0)
    return out


def options(kind: type[T], config: str = "", args: list[str] | None = None) -> T:
    """An instance of a dataclass of int, float and str fields; unknown keys are errors."""
    given = read_config(config) | read_arguments(args or [])
    types = {f.name: type(f.default) for f in dataclasses.fields(kind)}
    if unknown := given.keys() - types.keys():
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return kind(**{k: types[k](v) for k, v in given.items()})

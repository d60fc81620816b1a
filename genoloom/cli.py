"""python -m genoloom.cli TOOL --argument value ...: the arguments are the fields of the tool's data class."""

from __future__ import annotations

import argparse
import sys
import types
from dataclasses import MISSING, fields
from typing import get_args, get_origin, get_type_hints

from pyspark.sql import SparkSession

from genoloom.plans.tools import TOOLS


def parser(tool: type) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog=tool.__name__, description=tool.__doc__)
    hints = get_type_hints(tool)
    for f in fields(tool):
        kind = hints[f.name]
        if isinstance(kind, types.UnionType):
            kind = next(k for k in get_args(kind) if k is not type(None))
        name, needed = f"--{f.name.replace('_', '-')}", f.default is MISSING and f.default_factory is MISSING
        if kind is bool:
            out.add_argument(name, action="store_true", default=f.default)
        elif get_origin(kind) is dict:
            out.add_argument(name, action="append", metavar="NAME=FILE", required=needed, default=None if needed else [])
        elif get_origin(kind) is tuple:
            out.add_argument(name, action="append", default=[])
        elif kind in (int, float, str):
            out.add_argument(name, type=kind, required=needed, default=None if needed else f.default)
    return out


def parsed(tool: type, args: list[str]):
    values = vars(parser(tool).parse_args(args))
    hints = get_type_hints(tool)
    for k, v in values.items():
        if get_origin(hints[k]) is dict:
            values[k] = dict(x.split("=", 1) for x in v)
        elif get_origin(hints[k]) is tuple:
            values[k] = tuple(v)
    return tool(**values)


def main(args: list[str]) -> int:
    if not args or args[0] not in TOOLS:
        print("Tools: " + ", ".join(TOOLS), file=sys.stderr)
        return 2
    tool = parsed(TOOLS[args[0]], args[1:])
    tool.run(SparkSession.builder.appName(f"genoloom {args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

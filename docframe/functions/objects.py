"""Projections of object values (JSON text, as the readers give it): paths, typed getters and their coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def at(value: Column, *path: str | int) -> Column:
    """The JSON text at a path of names and places; null if a step is missing. References stay as {"$ref": [n, g]}."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(value, "$" + steps)


def real(value: Column) -> Column:
    """A number, or null for all else: text that only looks like one in part is no number."""
    return F.when(value.rlike(_REAL), value.cast("double"))


def integer(value: Column) -> Column:
    """A number cut off towards zero; null if it is none, or beyond 32 bits."""
    found = real(value)
    whole = F.when(found < 0, F.ceil(found)).otherwise(F.floor(found))
    return F.when(whole.between(-(1 << 31), (1 << 31) - 1), whole.cast("int"))


def boolean(value: Column) -> Column:
    return F.when(value == "true", True).when(value == "false", False)


def numbers(value: Column) -> Column:
    """An array of numbers; null if the value is no array or holds anything else."""
    found = F.transform(F.from_json(value, "array<string>"), real)
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


def matrix(value: Column, default: tuple[float, ...] = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)) -> Column:
    """Six numbers; the default where there are not just six."""
    found = numbers(value)
    return F.when(F.size(found) == 6, found).otherwise(F.array(*(F.lit(float(v)) for v in default)))


def reference(value: Column) -> Column:
    """The object number of a reference, null if the value is none."""
    return integer(F.get_json_object(value, "$['$ref'][0]"))


def either(value: Column, default: Column | int | float | str) -> Column:
    """A getter with a default."""
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))

"""Typed inputs and outputs of a model, and the rows that break their constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}


@dataclass
class Port:
    """One column of a table port with its constraints."""

    name: str
    type: str
    nullable: bool = True
    least: float | None = None
    most: float | None = None
    choices: tuple = ()
    pattern: str | None = None


def from_manifest(port: dict) -> list[Port]:
    out = []
    for c in port["schema"]["columns"]:
        k = c.get("constraints", {})
        out.append(Port(c["name"], c["type"], k.get("nullable", True), k.get("min"), k.get("max"), tuple(k.get("enum", ())), k.get("pattern")))
    return out


def typed(df: DataFrame, ports: list[Port]) -> DataFrame:
    """The ports' columns in their types; cells that don't convert are null."""
    return df.select(*[F.col(p.name).try_cast(TYPES[p.type]).alias(p.name) for p in ports])


def violations(df: DataFrame, ports: list[Port], key: str) -> DataFrame:
    """(key, column, problem) for every cell that breaks a constraint."""
    found = []
    for p in ports:
        c = F.col(p.name)
        v = c.try_cast(TYPES[p.type])
        tests = [("type", c.isNotNull() & v.isNull())]
        if not p.nullable:
            tests.append(("nullable", c.isNull()))
        if p.least is not None:
            tests.append(("min", v < p.least))
        if p.most is not None:
            tests.append(("max", v > p.most))
        if p.choices:
            tests.append(("enum", v.isNotNull() & ~v.isin(*p.choices)))
        if p.pattern:
            tests.append(("pattern", ~v.cast("string").rlike(f"^(?:{p.pattern})$")))
        found += [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(p.name).alias("column"), F.lit(n).alias("problem"))) for n, t in tests]
    every = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(key, F.inline(every))

"""Units by charter: ranked witnesses say what a price is for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyhouse.functions.text import fold_digits

#: Shapes in which a witness may state a quantity with a unit.
SHAPES = {
    "quantity": "(?i)\\b([0-9]+(?:\\.[0-9]+)?)\\s*{unit}\\b",
    "pair": "(?i)\\b([0-9]+(?:\\.[0-9]+)?)\\s*/\\s*{unit}\\b",
    "container": "(?i)\\b(?:bag|sack|drum|pail|box|roll)\\s+(?:of\\s+)?([0-9]+(?:\\.[0-9]+)?)\\s*{unit}\\b",
}


def resolved(witnesses: list[tuple[str, str]], units: list[str], corroborator: str | None = None) -> dict[str, Column]:
    """unit, quantity, witness and said: the first ranked witness (column, shape) that states an allowed unit.

    A corroborating column that states another quantity of the unit vetoes the reading.
    """
    options = []
    for column, shape in witnesses:
        for unit in units:
            q = F.regexp_extract(fold_digits(column), SHAPES[shape].format(unit=unit), 1).try_cast("double")
            agrees = F.lit(True)
            if corroborator:
                other = F.regexp_extract(fold_digits(corroborator), SHAPES["quantity"].format(unit=unit), 1).try_cast("double")
                agrees = other.isNull() | (F.abs(other - q) <= 1e-6)
            options.append(F.when(q.isNotNull() & F.coalesce(agrees, F.lit(True)), F.struct(F.lit(unit).alias("unit"), q.alias("quantity"), F.lit(f"{column}:{shape}").alias("witness"), F.col(column).alias("said"))))
    best = F.coalesce(*options)
    return {k: best[k] for k in ("unit", "quantity", "witness", "said")}

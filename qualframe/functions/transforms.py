"""Standardising transforms and synthetic names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualframe.functions.uid import key_hash

# Fixed value: kilometres in an international mile.
KM_PER_MILE = 1.609344


def str_to_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to timestamp; null where the text does not fit the pattern."""
    return F.try_to_timestamp(c, F.lit(pattern))


def miles_to_km(c: Column) -> Column:
    return c * F.lit(KM_PER_MILE)


def latlon_to_cell(lat: Column, lon: Column, degrees: float = 0.1) -> Column:
    """Identifier ``row_column`` of a fixed-degree grid cell; null outside the globe."""
    row = F.floor((lat + F.lit(90.0)) / F.lit(degrees)).cast("bigint")
    column = F.floor((lon + F.lit(180.0)) / F.lit(degrees)).cast("bigint")
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(inside, F.concat_ws("_", row.cast("string"), column.cast("string")))


# Invented name parts.
FIRST_NAMES = (
    "Ada", "Bela", "Cora", "Dario", "Edda", "Femi", "Gita", "Hugo", "Ines", "Jonas",
    "Kira", "Lars", "Mina", "Nilo", "Olga", "Pavel", "Quinn", "Rosa", "Sami", "Tova",
)
LAST_NAMES = (
    "Abel", "Brandt", "Cole", "Duval", "Eklund", "Falk", "Garcia", "Holm", "Iqbal", "Jansen",
    "Kovacs", "Lindt", "Moreau", "Novak", "Okoro", "Petrov", "Quist", "Rossi", "Sato", "Tanaka",
)


def synthetic_name(key: Column, seed: int = 0, algorithm: str = "xxhash64") -> Column:
    """A made-up name that depends only on the key and the seed."""
    number = key_hash(F.lit(seed), key, algorithm=algorithm)
    pick = lambda names, n: F.element_at(F.array(*[F.lit(name) for name in names]), (n % len(names) + 1).cast("int"))
    second = F.call_function("div", number, F.lit(len(FIRST_NAMES)).cast("bigint"))
    return F.concat_ws(" ", pick(FIRST_NAMES, number), pick(LAST_NAMES, second))

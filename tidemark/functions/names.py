"""Header names. Works on column metadata only."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame

# Canonical name <- all of these parts occur in the header. First match wins.
CANONICAL_PARTS = [
    ("precio_oro", ("oro", "precio")),
    ("trm", ("trm",)),
    ("tipm", ("tipm",)),
    ("dtf", ("dtf",)),
    ("precio_brent", ("brent",)),
    ("precio_cafe_centusd", ("caf",)),
    ("demanda_energetica", ("demanda", "ener")),
    ("inflacion_sin_alimentos", ("inflacion", "alimento")),
    ("precio_bolsa_nacional_energetica", ("bolsa", "ener")),
    ("bancolombia_price_usd", ("bancolombia",)),
]
# Headers that are canonical when equal, not when contained.
CANONICAL_EXACT = {"oro": "precio_oro"}


def normalize_header(name: object) -> str:
    """Lower-case ASCII snake case: ``' Precio/Oro (%) '`` -> ``precio_oro_pct``."""
    plain = unicodedata.normalize("NFKD", str(name).strip().replace("%", "pct"))
    plain = plain.encode("ascii", "ignore").decode("ascii")
    plain = re.sub(r"[\s/.\-]", "_", plain)
    plain = re.sub(r"[^0-9a-zA-Z_]", "", plain)
    return re.sub(r"_{2,}", "_", plain).strip("_").lower()


def canonical_name(header: str) -> str:
    if header in CANONICAL_EXACT:
        return CANONICAL_EXACT[header]
    for name, parts in CANONICAL_PARTS:
        if all(part in header for part in parts):
            return name
    return header


def source_prefix(source: str) -> str:
    """Prefix for the columns of one source: ``^VIX`` -> ``vix``, ``GC=F`` -> ``gc_f``."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", source).strip("_").lower()


def normalize_headers(df: DataFrame, canonical: bool = False) -> DataFrame:
    """Rename all columns; of columns that end up with one name the first is kept."""
    names = [normalize_header(c) for c in df.columns]
    if canonical:
        names = [canonical_name(n) for n in names]
    unique = df.toDF(*[f"__{i}" for i in range(len(names))])
    first: dict[str, int] = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    return unique.select(*[unique[f"__{i}"].alias(name) for name, i in first.items()])


def date_header(columns: list[str]) -> str:
    """The date column of a normalised table; the first column when none is named so."""
    named = [c for c in columns if c in ("fecha", "date", "dia", "time") or "fecha" in c]
    return (named or columns)[0]

"""Reproducible randomness: orders and uniforms that depend on a seed and a row's key, never on partitioning."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def digest(seed: int, salt: str, *key: Column) -> Column:
    """32 hexadecimal digits of MD5 over seed, salt and key (a null part is written as \\N)."""
    parts = [F.coalesce(k.cast("string"), F.lit("\\N")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *parts))


def integer(hexes: Column, start: int = 1, digits: int = 8) -> Column:
    """Some digits of a digest as a bigint."""
    return F.conv(F.substring(hexes, start, digits), 16, 10).cast("bigint")


def uniform(hexes: Column, start: int = 1) -> Column:
    """Eight digits of a digest as a number from 0 up to 1."""
    return integer(hexes, start) / F.lit(float(1 << 32))


def pick_seed(seed: int | None) -> tuple[int, list[str]]:
    """The seed, and a note that reports it if it had to be drawn."""
    if seed is not None:
        return seed, []
    seed = secrets.randbelow(1 << 31)
    return seed, [f"No seed given; drew {seed}."]

"""Random numbers as integer expressions: the same for any partitioning, and the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Mersenne prime and the mixing constants of a counter-based generator.
PRIME = 2147483647
B_STEP, I_STEP, OFFSET, B_MIX, I_MIX, LAST = 245489, 104729, 12345, 48271, 69621, 48271


def draw(replicate: Column, i: Column, n: Column) -> Column:
    """A number in [0, n) for counter ``i`` of a replicate; every intermediate stays below 2^63."""
    b, i, n = replicate.cast("long"), i.cast("long"), n.cast("long")
    x = (b * B_STEP + i * I_STEP + OFFSET) % PRIME
    x = (x * x + b * B_MIX + i) % PRIME
    x = (x * x + i * I_MIX + b) % PRIME
    return ((x * LAST) % PRIME) % n


def draw_sql(b: str, i: str, n: str) -> str:
    x = f"((({b})::BIGINT * {B_STEP} + ({i})::BIGINT * {I_STEP} + {OFFSET}) % {PRIME})"
    x = f"(({x} * {x} + ({b}) * {B_MIX} + ({i})) % {PRIME})"
    x = f"(({x} * {x} + ({i}) * {I_MIX} + ({b})) % {PRIME})"
    return f"((({x} * {LAST}) % {PRIME}) % ({n}))"


def lot(seed: Column | int, *keys: Column) -> Column:
    """A hex text that orders rows at random, the same in any engine: md5 of the seed and the keys."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in keys]).cast("binary"))


def lot_sql(seed: str, *keys: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"({k})::VARCHAR" for k in (seed, *keys)) + "))"

"""Column expressions: hashes, bit positions, character sums, vectors."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_sum(c: Column, n: int) -> Column:
    """The sum of a string's code points modulo n."""
    return F.aggregate(F.transform(F.split(c, ""), lambda x: F.ascii(x)), F.lit(0), lambda a, x: (a + x) % F.lit(n))


def big_int_mod(c: Column, p: int) -> Column:
    """The bytes of a string, read as one big-endian integer, modulo p < 2**31."""
    digits = F.transform(F.split(F.hex(F.encode(c, "UTF-8")), ""), lambda d: F.conv(d, 16, 10).cast("bigint"))
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: (a * 16 + F.coalesce(d, F.lit(0))) % F.lit(p))


def chunk_of(number: Column, chunks: int, seed: int = 11) -> Column:
    """One of so many chunks by a hash of a whole number (0 up to 2**31) that plain arithmetic can follow."""
    return F.pmod((number * 48_271 + seed) % 2_147_483_647, F.lit(chunks))


def universal_hash(x: Column, a: int, b: int, p: int, m: Column | int) -> Column:
    """((a x + b) mod p) mod m."""
    return (x * F.lit(a) + F.lit(b)) % F.lit(p) % (F.lit(m) if isinstance(m, int) else m)


def hash_rows(x: Column, family: list[tuple[int, int, int]], m: Column | int) -> Column:
    """An array of (i, h): each function of a family with its number, as one loop and not as many expressions."""
    parameters = F.lit([list(f) for f in family]).cast("array<array<bigint>>")
    bins = F.lit(m).cast("bigint") if isinstance(m, int) else m.cast("bigint")
    return F.transform(parameters, lambda f, i: F.struct(i.alias("i"), ((x * F.get(f, F.lit(0)) + F.get(f, F.lit(1))) % F.get(f, F.lit(2)) % bins).alias("h")))


def trailing_zeros(h: Column) -> Column:
    """Zero bits at the low end of a non-negative integer; 1 for zero, whose binary form is "0"."""
    return F.when(h == 0, 1).otherwise(F.locate("1", F.reverse(F.bin(h))) - 1).cast("int")


def primes_from(low: int, n: int) -> list[int]:
    """The first n primes not below a number."""
    out, x = [], max(2, low)
    while len(out) < n:
        if all(x % d for d in range(2, int(x**0.5) + 1)):
            out.append(x)
        x += 1
    return out


def hash_family(n: int, low: int, high: int, prime_from: int, seed: int) -> list[tuple[int, int, int]]:
    """n parameter triples (a, b, p) with a, b in [low, high), each with a prime of its own."""
    rng = random.Random(seed)
    return [(rng.randrange(low, high), rng.randrange(low, high), p) for p in primes_from(prime_from, n)]


def mahalanobis(x: Column, n: Column, total: Column, squares: Column) -> Column:
    """The distance of a vector from a cluster given by count, sums and sums of squares; no variance counts as 1e-10."""
    mean = F.transform(total, lambda s: s / n)
    variance = F.zip_with(F.transform(squares, lambda q: q / n), mean, lambda q, m: F.greatest(q - m * m, F.lit(0.0)))
    scaled = F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), variance, lambda d, v: d * d / F.when(v <= 1e-20, F.lit(1e-20)).otherwise(v))
    return F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, d: a + d))

"""A keyed pseudorandom permutation of 0 .. n - 1: Feistel rounds over a grid, with cycle-walking.

The grid has ``a * b`` cells with a = ceil(sqrt(n)), b = ceil(n / a), so fewer than a cells lie
outside; a place that lands outside is permuted again until it lands inside.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each index (0 .. n - 1) goes."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    seeds = _mix(np.arange(1, 2 * ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // np.uint64(b), out[todo] % np.uint64(b)
        for k in range(ROUNDS):
            left = (left + _mix(right ^ seeds[2 * k])) % np.uint64(a)
            right = (right + _mix(left ^ seeds[2 * k + 1])) % np.uint64(b)
        out[todo] = left * np.uint64(b) + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


#: Walks after the first pass. At most ceil(sqrt(n)) cells lie outside, so up to 64 ** 2 places always arrive; beyond, a walk of 64 steps has a chance below 64 ** -64.
WALK = 64


def permuted(index: Column | str, n: Column | str, key: Column | str) -> Column:
    """The same kind of permutation with SQL functions only; ``n`` and ``key`` may differ from row to row."""
    index, n, key = (F.col(x) if isinstance(x, str) else x for x in (index, n, key))
    a = F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    b = F.greatest(F.lit(1).cast("long"), F.ceil(n / a).cast("long"))
    shape = F.struct(index.cast("long").alias("x"), n.cast("long").alias("n"), key.alias("key"), a.alias("a"), b.alias("b"))

    def once(x: Column, s: Column) -> Column:
        begin = F.struct(F.floor(x / s["b"]).cast("long").alias("l"), F.pmod(x, s["b"]).alias("r"))

        def turn(acc: Column, k: Column) -> Column:
            # One round on each half; only the left one is mixed in first, so it goes in twice.
            left = F.pmod(acc["l"] + F.pmod(F.xxhash64(s["key"], k, F.lit(0), acc["r"]), s["a"]), s["a"])
            return F.struct(left.alias("l"), acc["r"].alias("r"))

        def swap(acc: Column, k: Column) -> Column:
            right = F.pmod(acc["r"] + F.pmod(F.xxhash64(s["key"], k, F.lit(1), acc["l"]), s["b"]), s["b"])
            return F.struct(acc["l"].alias("l"), right.alias("r"))

        rounds = F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1))
        return F.aggregate(rounds, begin, lambda acc, k: F.when(F.pmod(k, F.lit(2)) == 0, turn(acc, k)).otherwise(swap(acc, k)), lambda acc: acc["l"] * s["b"] + acc["r"])

    # transform over one struct names it once, however often its parts are used.
    def walk(s: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(WALK))
        return F.transform(F.array(once(s["x"], s)), lambda y: F.when(y < s["n"], y).otherwise(F.aggregate(steps, y, lambda z, _: F.when(z < s["n"], z).otherwise(once(z, s)))))[0]

    return F.transform(F.array(shape), walk)[0]

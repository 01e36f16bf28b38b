"""Affine permutations: a whole corpus is put into a random but reproducible order by arithmetic alone."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above this many rows the product of two of them needs more than 63 bits.
LONG_ROWS = 3_037_000_499


@dataclass(frozen=True)
class Permutation:
    """i -> (a i + b) mod n, with a coprime to n; ``inverse`` is that of a."""

    n: int
    a: int
    b: int
    inverse: int

    @classmethod
    def draw(cls, n: int, seed: int = 27) -> Permutation:
        """The draws of a seeded generator: a first, until it is coprime to n, then b."""
        if n <= 0:
            raise ValueError("an empty view has no order")
        if n == 1:
            return cls(1, 1, 0, 1)
        dice = random.Random(seed)
        a = dice.randint(1, n - 1)
        while math.gcd(a, n) != 1:
            a = dice.randint(1, n - 1)
        return cls(n, a, dice.randint(0, n - 1), pow(a, -1, n))

    def at(self, i: int) -> int:
        return (self.a * i + self.b) % self.n

    def position(self, index: Column) -> Column:
        """Where the row with global ``index`` stands in the permuted order: the inverse, row by row."""
        if self.n <= LONG_ROWS:
            return F.pmod(F.lit(self.inverse) * (index - F.lit(self.b)), F.lit(self.n)).cast("long")
        wide = (index - F.lit(self.b)).cast("decimal(19,0)") * F.lit(self.inverse).cast("decimal(19,0)")
        return F.pmod(wide, F.lit(self.n).cast("decimal(19,0)")).cast("long")

"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many decimals, rounded by its exact binary value; exact halves go to the even digit.

    ``format_string`` rounds the shortest decimal of a double and takes halves up, so 12.25 gives 12.3 there and 12.2
    here, and 2.675, which lies below its decimal, 2.68 there and 2.67 here.  For numbers below 2**52 / 10**digits.
    """
    x = x.cast("double")
    size = F.abs(x)
    twice = 2.0 * 10**digits
    p = size * twice
    # what the product lost, from the two halves of the number
    c = size * 134217729.0
    high = c - (c - size)
    lost = (high * twice - p) + (size - high) * twice
    n = F.floor(p)
    tie = (p == n) & (n % 2 == 1)
    up = (lost > 0) | ((lost == 0) & ((F.floor((n + 1) / 2) % 2) == 0))
    k = F.when(tie, F.floor(n / 2) + F.when(up, 1).otherwise(0)).otherwise(F.floor((p + 1) / 2)).cast("long")
    whole, rest = F.floor(k / 10**digits).cast("long").cast("string"), F.lpad((k % 10**digits).cast("string"), digits, "0")
    text = F.concat(whole, F.lit("."), rest) if digits else k.cast("string")
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)

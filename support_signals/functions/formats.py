"""Text formats of the reference reproduced with built-in Columns.

All rounding follows Python semantics (round-half-even on the exact binary
value of the float), computed with integer arithmetic so it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _half_even_div(a: Column, d: int) -> Column:
    """round(a / d) for integer a >= 0 where every tie is exact (d divides 2*10^k)."""
    n, rem = F.floor(a / F.lit(d)).cast("bigint"), F.pmod(a, F.lit(d))
    half = d // 2
    up = (rem > half) | ((rem == half) & (F.pmod(n, F.lit(2)) == 1))
    return n + up.cast("bigint")


def _millions_tenths(a: Column) -> Column:
    """Tenths of millions as Python's ``f"{a / 1e6:.1f}"`` prints them.

    Only amounts ending in 50,000 are ties.  Those that are multiples of
    250,000 are exact binary fractions (true tie, half-even).  For the others
    the float ``a / 1e6`` lies just above or below the tie; its side is found
    from the 53-bit rounding of (2n+1)/20 done in decimal integers.
    """
    n = F.floor(a / F.lit(100_000)).cast("bigint")
    rem = F.pmod(a, F.lit(100_000))
    odd = 2 * n + 1                                   # tie value t = odd / 20
    s = (F.lit(52) - F.floor(F.log2(odd / F.lit(20.0)))).cast("int")
    x = odd.cast("decimal(20,0)") * F.pow(F.lit(2.0), s).cast("decimal(18,0)")
    float_above = F.pmod(x, F.lit(20).cast("decimal(2,0)")) > 10
    exact_tie = F.pmod(a, F.lit(250_000)) == 0
    tie_up = F.when(exact_tie, F.pmod(n, F.lit(2)) == 1).otherwise(float_above)
    up = (rem > 50_000) | ((rem == 50_000) & tie_up)
    return n + up.cast("bigint")


def format_arr(amount) -> Column:
    """``$x.xM`` from one million, ``$nK`` from one thousand (half-even),
    else ``$n,nnn``.  The K branch is chosen before rounding: 999,999 -> $1000K."""
    a = _c(amount).cast("bigint")
    m = _millions_tenths(a)
    return (F.when(a >= 1_000_000, F.concat(F.lit("$"), F.floor(m / 10).cast("bigint").cast("string"), F.lit("."),
                                            F.pmod(m, F.lit(10)).cast("string"), F.lit("M")))
            .when(a >= 1_000, F.concat(F.lit("$"), _half_even_div(a, 1_000).cast("string"), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), F.format_number(a, 0))))


def pct0(x) -> Column:
    """``f"{x:.0%}"`` for a ratio."""
    return F.concat(F.bround(_c(x) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def title_case(x) -> Column:
    """``s.replace("_", " ").title()``: a capital after anything that is no letter, lower case elsewhere."""
    text = F.lower(F.regexp_replace(_c(x), "_", " "))
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.when(text.isNull(), text).otherwise(F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), ""))


def truncate(x, n: int = 52) -> Column:
    """Text longer than ``n`` keeps ``n - 1`` characters plus an ellipsis."""
    c = _c(x)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))

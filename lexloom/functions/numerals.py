"""Numeral trees of whole numbers from 1 to 10^12 - 1, by powers of a thousand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.trees import parse

LIMIT = 10**12


def below_10(n: int) -> str:
    return "pot01" if n == 1 else f"(pot0 n{n})"


def below_100(n: int) -> str:
    """Ten and eleven have names of their own, 12 to 19 a common form; then tens with and without ones."""
    if n < 10:
        return f"(pot0as1 {below_10(n)})"
    tens, ones = divmod(n, 10)
    if tens == 1:
        return "pot110" if ones == 0 else "pot111" if ones == 1 else f"(pot1to19 n{ones})"
    return f"(pot1 n{tens})" if ones == 0 else f"(pot1plus n{tens} {below_10(ones)})"


def below_1000(n: int, special: bool) -> str:
    if n < 100:
        return f"(pot1as2 {below_100(n)})"
    hundreds, rest = divmod(n, 100)
    if rest:
        return f"(pot2plus {below_10(hundreds)} {below_100(rest)})"
    return "pot21" if special and n == 100 else f"(pot2 {below_10(hundreds)})"


def tree(n: int, special: bool = True) -> str:
    """special: exactly 100, 1000, a million and a milliard have constants of their own."""
    if not 1 <= n < LIMIT:
        raise ValueError("a numeral is from 1 to 10^12 - 1")
    # power 2 counts hundreds, 3 thousands, 4 millions, 5 milliards
    def level(n: int, power: int) -> str:
        if power == 2:
            return below_1000(n, special)
        unit = 1000 ** (power - 2)
        head, rest = divmod(n, unit)
        if not head:
            return f"(pot{power - 1}as{power} {level(n, power - 1)})"
        if rest:
            return f"(pot{power}plus {below_1000(head, special)} {level(rest, power - 1)})"
        return f"pot{power}1" if special and head == 1 else f"(pot{power} {below_1000(head, special)})"

    return f"(num {level(n, 5)})"


def numeral(n: Column) -> Column:
    """The tree of a column of whole numbers; null outside the range. A group of three digits is looked up in
    a constant table of the numbers below a thousand, and the levels hold one another."""
    n = n.cast("long")
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    small = F.split(F.lit("|".join(below_1000(k, True) if k else "(pot1as2 none)" for k in range(1000))), r"\|")
    out = F.get(small, n % 1000)
    for power in (3, 4, 5):
        unit = 1000 ** (power - 2)
        head = F.call_function("div", n, F.lit(unit)) % 1000
        # nothing of this unit; something below it; the unit once; so many of it
        out = (
            F.when(head == 0, text(f"(pot{power - 1}as{power} ", out, ")"))
            .when(n % unit > 0, text(f"(pot{power}plus ", F.get(small, head), " ", out, ")"))
            .when(head == 1, f"pot{power}1")
            .otherwise(text(f"(pot{power} ", F.get(small, head), ")"))
        )
    return F.when(n.between(1, LIMIT - 1), text("(num ", out, ")"))


def value(text: str) -> int:
    """The number that a tree stands for."""
    def go(t) -> int:
        f, args = t.fun, [go(a) for a in t.args]
        if f == "pot01":
            return 1
        if f in ("pot110", "pot111"):
            return 10 if f == "pot110" else 11
        if f[0] == "n" and f[1:].isdigit():
            return int(f[1:])
        units = {"1": 10, "2": 100, "3": 1000, "4": 10**6, "5": 10**9}
        if f == "pot1to19":
            return 10 + args[0]
        if f[3:] in ("21", "31", "41", "51"):
            return units[f[3]]
        if f.endswith("plus"):
            return args[0] * units[f[3]] + args[1]
        if f[3:] in units:
            return args[0] * units[f[3]]
        return args[0]

    return go(parse(text))

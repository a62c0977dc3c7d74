"""Number formats against big-integer arithmetic, on random bit patterns and hard cases."""

import math
import random
import struct
from decimal import ROUND_HALF_UP, Context, Decimal

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import numfmt

WIDE = Context(prec=2000)
HARD = [0.0, -0.0, 0.1, 0.5, 1.5, 2.5, -2.5, 1.005, 8.345, 9.995, 0.0375, 0.125, 99.95, 999999.5, 1e15, 1e16, 1e20, 1.2345678901234568e20, 1e21, 1e22, 2.0**53, 2.0**63, 2.0**64, 1e-6, 1e-7, 1e-24, 1e-25, 1e-30, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0**-44, 123456.789, math.inf, -math.inf, math.nan]


def numbers():
    rng = random.Random(9)
    bits = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(150)]
    return HARD + bits + [rng.choice([-1, 1]) * rng.uniform(0, 10 ** rng.randrange(-3, 20)) for _ in range(150)] + [rng.randrange(10**7) / 10**rng.randrange(5) for _ in range(150)]


def digits(a, n):
    """The first n digits and the power of ten, halves up."""
    if a == 0:
        return "0" * n, 0
    d = Context(prec=n, rounding=ROUND_HALF_UP, Emin=-400, Emax=400).plus(Decimal(a))
    return "".join(map(str, d.as_tuple().digits)).ljust(n, "0"), d.adjusted()


def placed(t, e):
    return "0." + "0" * (-e - 1) + t if e < 0 else t + "0" * (e - len(t) + 1) if e >= len(t) - 1 else t[: e + 1] + "." + t[e + 1 :]


def powered(t, e):
    return t[0] + ("." + t[1:] if len(t) > 1 else "") + f"e{e:+d}"


def shortest(a):
    d = Decimal(repr(a))
    t, e = "".join(map(str, d.as_tuple().digits)).rstrip("0") or "0", d.adjusted() if a else 0
    return powered(t, e) if e >= 21 or e < -6 else placed(t, e)


def fixed(a, n):
    return shortest(a) if a >= 1e21 else format(Decimal(a).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP, WIDE), 'f')


def trimmed(t):
    head, mark, tail = t.partition("e")
    return (head.rstrip("0").rstrip(".") if "." in head else head) + mark + tail


def general(a, n):
    t, e = digits(a, n)
    return powered(t, e) if e < -6 or e >= n else placed(t, e)


def whole(a):
    return int(Decimal(a).quantize(Decimal(1), ROUND_HALF_UP, WIDE))


def si(a, n):
    t, e = digits(a, n)
    third = max(-8, min(8, e // 3))
    prefix = "y z a f p n µ m  k M G T P E Z Y".split(" ")[third + 8]
    if e < -24:
        left = n + e + 24
        few = digits(a, left)[0] if left > 0 else "".join(map(str, Decimal(repr(a)).as_tuple().digits)).rstrip("0")
        return "0." + "0" * (-e - 25) + few + prefix
    return placed(t, e - third * 3) + prefix


SPECS = {
    ".2f": lambda a: fixed(a, 2), ".0f": lambda a: fixed(a, 0), ".20f": lambda a: fixed(a, 20), ".25f": lambda a: fixed(a, 20), "e": lambda a: powered(*digits(a, 7)), ".0e": lambda a: powered(*digits(a, 1)), ".17e": lambda a: powered(*digits(a, 18)),
    ".4g": lambda a: general(a, 4), ".15g": lambda a: general(a, 15), ".21g": lambda a: general(a, 21), "": lambda a: trimmed(general(a, 12)), ".3~g": lambda a: trimmed(general(a, 3)), ".3r": lambda a: placed(*digits(a, 3)),
    "s": lambda a: si(a, 6), ".2s": lambda a: si(a, 2), "x": lambda a: f"{whole(a):x}", "X": lambda a: f"{whole(a):X}", "o": lambda a: f"{whole(a):o}", "b": lambda a: f"{whole(a):b}", "d": lambda a: shortest(float(whole(a))), "c": shortest,
    ".1%": lambda a: fixed(a * 100, 1) if a * 100 < math.inf else "Infinity", ".3p": lambda a: placed(*digits(a * 100, 3)) if a * 100 < math.inf else "Infinity",
}


def expected(x, spec):
    if math.isnan(x):
        return "NaN" + ("%" if spec[-1:] in ("%", "p") else "")
    a = abs(x)
    body = "Infinity" if a == math.inf else SPECS[spec](a)
    minus = x < 0 and (spec == "c" or body == "Infinity" or any(c in "123456789abcdefABCDEF" for c in body.split("e")[0] if spec != "e") or any(c in "123456789" for c in body.split("e")[0]))
    if spec in ("x", "X", "b", "o", "d"):
        minus = x < 0 and body.strip("0") != ""
    return ("-" if minus else "") + body + ("%" if spec[-1:] in ("%", "p") else "")


@pytest.mark.parametrize("spec", list(SPECS))
def test_types_against_big_integers(spark, spec):
    values = numbers()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, n double").repartition(4)
    got = {r.i: r.t for r in df.select("i", numfmt.format_number(F.col("n"), spec).alias("t")).collect()}
    wrong = [(v, got[i], expected(v, spec)) for i, v in enumerate(values) if got[i] != expected(v, spec)]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize(("x", "spec", "text"), [
    (1e20, ".2f", "100000000000000000000.00"), (1e21, "d", "1e+21"), (math.inf, ".2f", "Infinity"), (-math.inf, "e", "-Infinity"), (math.inf, "012.1f", "0000Infinity"), (1e-30, "s", "0.000001y"), (1e-30, ".8s", "0.0000010y"),
    (1234.0, "010,d", "00,001,234"), (1234.0, "08,d", "0,001,234"), (-1234.5, "012,.1f", "-00,001,234.5"), (1234567.0, "06,d", "1,234,567"), (-0.4, "+.0f", "-0"), (0.0, "+.0f", "+0"), (-0.4, ".0f", "0"), (-1.5, "(.1f", "(1.5)"),
    (42.0, "#x", "0x2a"), (-42.0, "#010b", "-0b0101010"), (65.5, "c", "65.5"), (-0.25, "$.1%", "-$25.0"), (1e6, "*^12,d", "*1,000,000**"), (3.0, "=+5d", "+   3"), (3.0, "<5d", "3    "), (1e15, ",x", "3,8d7,ea4,c68,000"),
])
def test_dress(spark, x, spec, text):
    df = spark.createDataFrame([(x,)], "n double")
    assert df.select(numfmt.format_number(F.col("n"), spec)).first()[0] == text


def test_null_prefix_and_currency(spark):
    df = spark.createDataFrame([(None,), (1500.0,)], "n double")
    got = df.select(numfmt.format_number(F.col("n"), "$,.2f", currency=("€", "'")).alias("a"), numfmt.format_prefix(F.col("n"), ",.2", 7).alias("b"), numfmt.format_number(F.col("n"), ",.1f", (2, 3)).alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("€1,500.00'", "0.00M", "15,00.0")]

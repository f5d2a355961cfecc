"""Item codes with a Verhoeff check digit, keyed hashes and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_SERIAL = 147_723
COUNTRY = "72"


def _dihedral() -> tuple[list[list[int]], list[list[int]], list[int]]:
    """Multiplication of the dihedral group of order 10, powers of Verhoeff's permutation, and inverses."""
    def times(a: int, b: int) -> int:
        turn = (a + b) % 5 if a < 5 else (a - b) % 5
        return turn + (0 if (a < 5) == (b < 5) else 5)

    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([step[x] for x in powers[-1]])
    table = [[times(a, b) for b in range(10)] for a in range(10)]
    return table, powers, [row.index(0) for row in table]


def _verhoeff(digits: Column, shift: int) -> Column:
    table, powers, _ = _dihedral()
    d, p = F.lit([x for row in table for x in row]), F.lit([x for row in powers for x in row])
    n = F.length(digits)

    def step(c: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).try_cast("int")
        return F.get(d, c * 10 + F.get(p, F.pmod(i + shift, F.lit(8)) * 10 + digit))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def check_digit(digits: Column) -> Column:
    return F.get(F.lit(_dihedral()[2]), _verhoeff(digits, 1))


def check_valid(digits: Column) -> Column:
    return F.coalesce(digits.rlike("^[0-9]+$") & (_verhoeff(digits, 0) == 0), F.lit(False))


def mint(serial: Column, nsc: Column, country: str = COUNTRY) -> Column:
    """NSC-country-sss-ssss/check, the serial modulo 10 million."""
    number = F.lpad(F.pmod(serial.cast("long"), F.lit(10_000_000)).cast("string"), 7, "0")
    core = F.concat(nsc, F.lit(country), number)
    return F.concat(nsc, F.lit(f"-{country}-"), F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 4), F.lit("/"), check_digit(core).cast("string"))


def parse(code: Column) -> Column:
    """struct(core, check) of a code in any spelling of 13 or 14 digits; check is null with 13; null for anything else."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"[\s\-/]", "")
    return F.when(digits.rlike("^[0-9]{13,14}$"), F.struct(F.substring(digits, 1, 13).alias("core"), F.when(F.length(digits) == 14, F.substring(digits, 14, 1).cast("int")).alias("check")))


def validate(code: Column) -> Column:
    """struct(parsed, stated, expected, valid)."""
    p = parse(code)
    expected = F.when(p.isNotNull(), check_digit(p["core"]))
    return F.struct(p.isNotNull().alias("parsed"), p["check"].alias("stated"), expected.alias("expected"), F.coalesce(p["check"] == expected, F.lit(False)).alias("valid"))


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC-SHA256 by nested SHA-256; the key stays on the driver as two constant pads."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    inside = F.sha2(F.concat(inner, F.coalesce(message, F.lit("")).cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(inside)), 256)


def keyed(message: Column, salt: str) -> Column:
    return F.substring(hmac_sha256(message, salt), 1, 32)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))

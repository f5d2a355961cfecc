"""Units of measure: plain units, packs and prices per base unit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions import knowledge as K
from partwise.functions import text as X

KIND = "struct<code:string,dimension:string,qty_per_uom:double,base_code:string,is_pack:boolean,pack_source:string,known:boolean>"


def _units() -> Column:
    """Name to struct(code, dimension, factor); of units that share a name the last."""
    names: dict[str, tuple] = {}
    for code, (dimension, factor, aliases) in K.UNITS.items():
        for name in [*aliases, code]:
            names[name] = (code, dimension, factor)
    return X.mapping({n: {"code": c, "dimension": d, "factor": f} for n, (c, d, f) in names.items()}, "struct<code:string,dimension:string,factor:double>")


def _packs() -> Column:
    names: dict[str, tuple] = {}
    for pack, (dimension, qty, unit, aliases) in K.PACKS.items():
        for name in [*aliases, pack]:
            names[name] = (dimension, qty, unit, K.UNITS[unit][1])
    return X.mapping({n: {"dimension": d, "qty": q * f, "unit": u} for n, (d, q, u, f) in names.items()}, "struct<dimension:string,qty:double,unit:string>")


def pack_content(cleaned: Column) -> Column:
    """struct(qty, unit) that a description states for its pack; null if none."""
    out = F.lit(None)
    for pattern in reversed(K.PACK_PATTERNS):
        qty = F.regexp_extract(cleaned, pattern, 1).try_cast("double")
        out = F.when(qty > 0, F.struct(qty.alias("qty"), F.regexp_extract(cleaned, pattern, 2).alias("unit"))).otherwise(out)
    return out


def resolve(uom: Column, cleaned: Column) -> Column:
    """A unit, or a pack with the content that its description states or that is usual; anything else is one piece (known = false).

    Fields: code, dimension, qty_per_uom, base_code, is_pack, pack_source (explicit, default or ''), known.
    """
    bases = X.mapping(K.BASES)

    def made(code: Column, dimension: Column, qty: Column, is_pack: bool, source: str, known: bool = True) -> Column:
        return F.struct(code.alias("code"), dimension.alias("dimension"), qty.alias("qty_per_uom"), F.element_at(bases, dimension).alias("base_code"), F.lit(is_pack).alias("is_pack"), F.lit(source).alias("pack_source"), F.lit(known).alias("known"))

    def packed(v: Column) -> Column:
        pack, content, inner = v["pack"], v["content"], v["inner"]
        stated = made(F.coalesce(inner["code"], pack["unit"]), F.coalesce(inner["dimension"], pack["dimension"]), content["qty"] * F.coalesce(inner["factor"], F.lit(1.0)), True, "explicit")
        return F.when(pack.isNotNull() & content.isNotNull(), stated).when(pack.isNotNull(), made(pack["unit"], pack["dimension"], pack["qty"], True, "default"))

    def found(raw: Column) -> Column:
        unit = X.let(F.try_element_at(_units(), raw), lambda u: F.when(u.isNotNull(), made(u["code"], u["dimension"], u["factor"], False, "")))
        with_inner = lambda content: F.struct(F.try_element_at(_packs(), raw).alias("pack"), content.alias("content"), F.try_element_at(_units(), X.basic(content["unit"])).alias("inner"))
        pack = X.let(X.let(X.let(cleaned, pack_content), with_inner), packed)
        return F.coalesce(unit, pack, made(F.lit("C62"), F.lit("count"), F.lit(1.0), False, "", False))

    return X.let(X.basic(uom), found)


def base_price(price: Column, unit: Column) -> Column:
    """Price of one base unit, 6 places; null without a price."""
    return F.when(unit["qty_per_uom"] > 0, F.round(price / unit["qty_per_uom"], 6))


def comparable(a: Column, b: Column) -> Column:
    return a["dimension"] == b["dimension"]


def convert(qty: Column, a: Column, b: Column) -> Column:
    """qty of unit a in unit b; null if their dimensions differ."""
    return F.when(comparable(a, b), qty * F.try_divide(a["qty_per_uom"], b["qty_per_uom"]))


def anomaly(price_a: Column, a: Column, price_b: Column, b: Column) -> Column:
    """How far two prices are apart as stated and per base unit; explained: more than 3 as stated, less than 1.5 then."""
    def ratio(x: Column, y: Column) -> Column:
        return F.round(F.try_divide(F.greatest(x, y), F.least(x, y)), 4)

    raw, normal = ratio(price_a, price_b), F.when(comparable(a, b), ratio(base_price(price_a, a), base_price(price_b, b)))
    return F.struct(raw.alias("raw_ratio"), normal.alias("normalised_ratio"), F.coalesce((raw > 3) & (normal < 1.5), F.lit(False)).alias("explained_by_unit"))

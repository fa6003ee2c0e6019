"""Raw strings to typed values, as Column expressions that never raise.

Each builder gives the value (null if it cannot be read) and whether the trimmed text has the right form. Everything
is built from expressions that take part in code generation; there is no Python on the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.formats import java_pattern
from strata.plans.manifest import Field, Kind

#: What counts as a yes or a no, whatever the case.
YES, NO = ("true", "1", "y", "yes"), ("false", "0", "n", "no")
#: White space of any script.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WHOLE, _REAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ISO_DATE, _US_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
_CLOCK = r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?"
_ISO_TIME = rf"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ]{_CLOCK})?$"
_ZONED = rf"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[T ]{_CLOCK} ?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$"
_HEX = "[0-9a-f]"
_GUID = rf"^({_HEX}{{32}}|D|\{{D\}}|\(D\))$".replace("D", "-".join(f"{_HEX}{{{n}}}" for n in (8, 4, 4, 4, 12)))


def trimmed(raw: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(raw, F.lit(_SPACES))


def blank(raw: Column) -> Column:
    return raw.isNull() | (trimmed(raw) == "")


def filled(raw: Column, default: str | None) -> Column:
    """Trimmed text; the default, trimmed, where it is blank; null where both are."""
    text = F.nullif(trimmed(raw), F.lit(""))
    return F.coalesce(text, F.nullif(trimmed(F.lit(default)), F.lit(""))) if default is not None else text


def _time_micros(text: Column) -> Column:
    part = lambda i: F.coalesce(F.try_element_at(F.split(text, "[:.]"), F.lit(i)), F.lit("0"))
    number = lambda i: part(i).try_cast("long")
    micros = F.rpad(F.substring(part(4), 1, 6), 6, "0").try_cast("long")
    return F.when(text.isNotNull() & (number(1) < 24) & (number(2) < 60) & (number(3) < 60), ((number(1) * 60 + number(2)) * 60 + number(3)) * 1_000_000 + micros)


def parsed(text: Column, kind: Kind, fmt: str | None = None, precision: int = 18, scale: int = 6) -> tuple[Column, Column]:
    """(value, fits) of a text that isn't blank. A decimal that fits its form may be null or too wide: see overflows."""
    if kind is Kind.STRING:
        return text, F.lit(True)
    if kind in (Kind.INT32, Kind.INT64):
        value = F.when(text.rlike(_WHOLE), text.try_cast("int" if kind is Kind.INT32 else "bigint"))
        return value, value.isNotNull()
    if kind is Kind.DECIMAL:
        fits = text.rlike(_REAL)
        return F.when(fits, text.try_cast(f"decimal(38,{scale})")), fits
    if kind is Kind.DOUBLE:
        value = F.when(text.rlike(_REAL), text.try_cast("double"))
        return value, value.isNotNull()
    if kind is Kind.BOOLEAN:
        value = F.when(F.lower(text).isin(*YES), True).when(F.lower(text).isin(*NO), False)
        return value, value.isNotNull()
    if kind is Kind.GUID:
        low = F.lower(text)
        bare = F.regexp_replace(low, r"[-{}()]", "")
        canonical = F.concat_ws("-", *[F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        value = F.when(low.rlike(_GUID), canonical)
        return value, value.isNotNull()
    if kind is Kind.DATE:
        if fmt:
            value = F.try_to_date(text, java_pattern(fmt))
        else:
            value = F.when(text.rlike(_ISO_DATE), text.try_cast("date")).when(text.rlike(_US_DATE), F.try_to_date(text, "M/d/yyyy")).when(text.rlike(_ISO_TIME), text.try_cast("timestamp_ntz").cast("date"))
        return value, value.isNotNull()
    if kind is Kind.DATETIME:
        if fmt:
            value = F.try_to_timestamp(text, F.lit(java_pattern(fmt))).cast("timestamp_ntz")
        else:
            zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.regexp_replace(text, " ?(Z|[+-][0-9:]+)$", "$1").try_cast("timestamp").cast("timestamp_ntz"))
            value = F.when(text.rlike(_ISO_TIME), text.try_cast("timestamp_ntz")).when(text.rlike(_US_DATE), F.try_to_date(text, "M/d/yyyy").cast("timestamp_ntz")).when(text.rlike(_ZONED), zoned)
        return value, value.isNotNull()
    if fmt:
        clock = F.date_format(F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), text), F.lit("yyyy-MM-dd " + java_pattern(fmt))), "HH:mm:ss.SSSSSS")
        value = _time_micros(clock)
    else:
        value = F.when(text.rlike(f"^{_CLOCK}$"), _time_micros(text))
    return value, value.isNotNull()


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def shown(text: Column) -> Column:
    """A value as it appears in a message: at most 60 characters."""
    return F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text)


def finished(text: Column, value: Column, fits: Column, field: Field, key: bool = False, key_length: int = 400) -> tuple[Column, Column]:
    """(typed value, fault) from the filled text and what parsed made of it. The fault is the first of: not readable,
    missing though required, too long, too wide; null if there is none."""
    fault = F.when(text.isNotNull() & ~fits, F.concat(F.lit("cannot read '"), shown(text), F.lit(f"' as {field.type.value}")))
    if field.required:
        fault = fault.when(text.isNull(), F.lit("a value is required"))
    if field.type is Kind.STRING and (most := field.max_length or (key_length if key else None)):
        # Few texts are long enough to be encoded for counting: one character is one or two units.
        fault = fault.when((F.length(text) * 2 > most) & (utf16_length(text) > most), F.concat(utf16_length(text).cast("string"), F.lit(f" characters; at most {most} fit")))
    if field.type is Kind.DECIMAL:
        # The bound is typed as narrowly as it can be: comparing two wide decimals would round.
        digits = field.precision - field.scale
        bound = F.lit("1" + "0" * digits).cast(f"decimal({digits + 1},0)") if field.precision < 38 else None
        wide = value.isNull() | (F.abs(value) >= bound) if bound is not None else value.isNull()
        fault = fault.when(text.isNotNull() & wide, F.lit(f"does not fit decimal({field.precision},{field.scale})"))
        # A value that is too wide is null in the narrower type by itself.
        return value.try_cast(f"decimal({field.precision},{field.scale})"), fault
    if field.type is Kind.STRING:
        return F.when(fault.isNull(), value) if field.max_length or key else value, fault
    return value, fault


def convert(raw: Column, field: Field, key: bool = False, key_length: int = 400) -> tuple[Column, Column]:
    """(typed value, fault) of a field that is no lookup, in one expression each."""
    text = filled(raw, field.default)
    return finished(text, *parsed(text, field.type, field.format, field.precision, field.scale), field, key, key_length)

"""Text and number formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Largest integer a double holds exactly: 2^53 - 1.
SAFE_INTEGER = 9007199254740991
# Outside this range a number is printed as plain text.
_FIXED_LIMIT = 1e15


def fmt_integer(c: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(c, 0)


def fmt_locale(c: Column) -> Column:
    """Number with thousands separators and up to three decimals."""
    return F.regexp_replace(F.format_number(F.round(c, 3), 3), r"\.?0+$", "")


def fmt_fixed(c: Column, digits: int) -> Column:
    """Fixed decimals, rounding the exact binary value (1.005 gives 1.00).

    ``printf`` rounds the shortest decimal text of a double instead, so the
    fraction is rounded here in whole numbers: it is a multiple of 2^-53.
    """
    size = F.abs(c)
    whole = F.floor(size)
    unit = 1 << 53
    bits = ((size - whole) * F.lit(float(unit))).cast("bigint").cast("decimal(20,0)")
    doubled = bits * F.lit(2 * 10**digits).cast("decimal(16,0)") + F.lit(unit).cast("decimal(20,0)")
    divisor = F.lit(2 * unit).cast("decimal(20,0)")
    scaled = ((doubled - doubled % divisor) / divisor).cast("bigint")
    carry = (scaled >= F.lit(10**digits)).cast("bigint")
    whole_text = (whole + carry).cast("string")
    rest = F.lpad((scaled - carry * F.lit(10**digits)).cast("string"), max(digits, 1), "0")
    text = F.concat(whole_text, F.lit("."), rest) if digits else whole_text
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    short = size < F.lit(_FIXED_LIMIT)
    return F.when(short, F.concat(sign, text)).when(~short, F.printf(F.lit(f"%.{digits}f"), c))


def strip_extension(c: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(c, r"\.[^/.]+$", "")


def sanitize_name(c: Column) -> Column:
    """Everything but ASCII letters, digits, dot and dash becomes an underscore."""
    return F.regexp_replace(c, "[^a-zA-Z0-9.-]", "_")


def swap_first(c: Column, old: str, new: str) -> Column:
    """Replace the first occurrence of ``old`` only."""
    at = F.locate(old, c)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def object_key(org: Column, project: Column, ts: Column, name: Column) -> Column:
    """``org/project/millis-name`` with the name sanitised."""
    millis = F.unix_millis(ts.cast("timestamp")).cast("string")
    return F.concat_ws("/", org, project, F.concat(millis, F.lit("-"), sanitize_name(name)))


def full_name(first: Column, last: Column) -> Column:
    """First and last name joined by a blank, missing parts left out."""
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def initial(c: Column, default: str = "U") -> Column:
    """First character, or a default for a missing or empty text."""
    return F.coalesce(F.nullif(F.substring(c, 1, 1), F.lit("")), F.lit(default))


def text_or(c: Column, default: str) -> Column:
    """A default for text that is missing or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def has_text(c: Column) -> Column:
    """True where something other than white space is left after trimming."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def safe_integer(c: Column) -> Column:
    """Struct {num, txt}: whole numbers a double cannot hold exactly become text.

    ``c`` is an integer or a decimal without fraction, for numbers past 64 bits.
    """
    safe = c.between(-SAFE_INTEGER, SAFE_INTEGER)
    return F.struct(
        F.when(safe, c).cast("bigint").alias("num"), F.when(c.isNotNull() & ~safe, c.cast("string")).alias("txt")
    )


def safe_integers(c: Column, data_type: T.DataType) -> Column:
    """``safe_integer`` applied to every whole number inside arrays, maps and structs."""
    if isinstance(data_type, T.LongType) or (isinstance(data_type, T.DecimalType) and data_type.scale == 0):
        return safe_integer(c)
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: safe_integers(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(c, lambda _, x: safe_integers(x, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [safe_integers(c.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def megabytes(c: Column) -> Column:
    return F.round(c / 1024 / 1024, 2)


def percent_change(old: Column, new: Column) -> Column:
    """Signed change in percent of the old value; NULL when that is zero."""
    return F.try_divide(new - old, old) * 100


def age_bucket(ts: Column, now: Column) -> Column:
    """Relative age such as '3 days ago', from a given present time."""
    seconds = F.timestamp_diff("SECOND", ts, now)

    def ago(unit: str, size: int) -> Column:
        n = F.floor(seconds / size)
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    minute, hour, day, month, year = 60, 3600, 86400, 30 * 86400, 365 * 86400
    return (
        F.when(seconds < minute, F.lit("less than a minute ago"))
        .when(seconds < hour, ago("minute", minute))
        .when(seconds < day, ago("hour", hour))
        .when(seconds < month, ago("day", day))
        .when(seconds < year, ago("month", month))
        .otherwise(ago("year", year))
    )

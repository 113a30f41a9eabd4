"""What one text value is: its kind, its readings as a number or a date, and its spelling-free key.

Every function takes and returns Column expressions, so a profile stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters removed from both ends of a cell before it is looked at.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The number and date spellings that are recognised, tried in this order.
INTEGER = r"^[+-]?[0-9]+$"
THOUSANDS = r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+$"
DECIMAL_BR = r"^[+-]?([0-9]{1,3}(\.[0-9]{3})+|[0-9]+),[0-9]+$"
DECIMAL_US = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"
DAY_MONTH_DATE = r"^[0-9]{1,2}([/.-])[0-9]{1,2}\1[0-9]{4}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"

# Numbers of one form, which differ in their digits only: in 18 characters these fit a long, and both readings the decimal.
FORMED, FORMED_SIZE = r"^[+-]?([0-9]{1,3}(\.[0-9]{3})+(,[0-9]{1,10})?|[0-9]+([.,][0-9]{1,10})?)$", 18

NUMBER, NUMBER_DIGITS, NUMBER_SCALE = "decimal(38,10)", 28, 10
# Powers of ten in sortable keys, and the most zeros a number is spelled with.
POWER_BIAS, POWER_DIGITS, PLAIN_DIGITS = 10**18, 19, 1000

# One bit per kind, so the set of kinds in a column is a single bit_or.
KIND_BITS = {"integer": 1, "int_thousands": 2, "decimal_br": 4, "decimal": 8, "boolean": 16, "date": 32, "text": 64}
NUMERIC_BITS = KIND_BITS["integer"] | KIND_BITS["int_thousands"] | KIND_BITS["decimal_br"] | KIND_BITS["decimal"]

# A date pattern as one number: a multiple of 128 for the family and separator, plus the clock parts.
ISO_CODE, FAMILY_STEP = 128, 128
SEPARATOR_CODES = {"/": 256, ".": 384, "-": 512}
T_SEPARATOR, CLOCK, SECONDS = 4, 2, 1

# What a column's dates showed, one bit each.
NOT_DAY_FIRST, NOT_MONTH_FIRST, PADDED, UNPADDED, HOUR_PADDED, HOUR_UNPADDED = 1, 2, 4, 8, 16, 32


def trimmed(cell: Column) -> Column:
    """The cell without surrounding whitespace; NULL when nothing is left.

    A cell that starts and ends with a visible ASCII character is taken as it is, as looking its ends up among all
    whitespace takes long. Its last byte is its last character, if there is a character at that place at all.
    """
    text = cell.cast("string")
    visible = F.ascii(text).between(33, 126) & F.ascii(F.substr(text, F.octet_length(text))).between(33, 126)
    return F.when(visible, text).otherwise(F.nullif(F.trim(text, F.lit(WHITESPACE)), F.lit("")))


def kind(value: Column, date: Column) -> Column:
    """The kind of a trimmed value, given its ``date`` reading. The order of the tests matters: ``007`` is an integer, ``1.234`` thousands.

    Numbers and dates can only start with a digit, a sign or a point; that cheap test keeps long texts
    away from the regular expressions.
    """
    numeric_start = F.ascii(value).between(ord("+"), ord("9"))
    # A pattern, because lower() goes through the full Unicode case tables.
    boolean = F.octet_length(value).between(4, 5) & value.rlike("(?i)^(true|false)$")
    return (
        F.when(value.isNull(), None)
        .when(numeric_start & value.rlike(INTEGER), "integer")
        .when(numeric_start & value.rlike(THOUSANDS), "int_thousands")
        .when(numeric_start & value.rlike(DECIMAL_BR), "decimal_br")
        .when(numeric_start & value.rlike(DECIMAL_US), "decimal")
        .when(boolean, "boolean")
        .when(date.isNotNull(), "date")
        .otherwise("text")
    )


def form(value: Column) -> dict[str, Column]:
    """The form of a short number, NULL throughout for all other values, and its ``digits`` as one signed whole number.

    Values of one form have their marks in the same places, so their digits sort as the values do under every reading,
    and what their spelling shows is told by the form and the extremes: most leading zeros by the digits nearest to zero.
    """
    formed = (F.octet_length(value) <= FORMED_SIZE) & F.ascii(value).between(ord("+"), ord("9")) & value.rlike(FORMED)
    bare = F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit(""))
    shown = {
        "size": F.octet_length(value), "marks": F.octet_length(value) - F.octet_length(bare),
        "point": F.instr(value, "."), "comma": F.instr(value, ","),
        "sign": F.when(F.startswith(value, F.lit("-")), "-").when(F.startswith(value, F.lit("+")), "+").otherwise(""),
        "zero_end": F.endswith(value, F.lit("0")), "digits": bare.cast("bigint"),
    }
    return {name: F.when(formed, c) for name, c in shown.items()}


def of_form(digits: Column, size: Column, marks: Column, point: Column, comma: Column, sign: Column) -> Column:
    """The value that has a form and these digits; the inverse of ``form``."""
    plain = F.lpad(F.abs(digits).cast("string"), size - marks - F.length(sign), "0")
    after = F.when(comma > 0, size - comma).when(marks == 1, size - point).otherwise(0)
    whole = F.left(plain, F.length(plain) - after)
    grouped = F.when(marks > F.when(after > 0, 1).otherwise(0), F.regexp_replace(whole, "(?<=[0-9])(?=([0-9]{3})+$)", ".")).otherwise(whole)
    mark = F.when(after == 0, "").when(comma > 0, ",").otherwise(".")
    return F.concat(sign, grouped, mark, F.right(plain, after))


def us_text(value: Column, value_kind: Column) -> Column:
    """The value spelled with a decimal point, as the US reading takes it. NULL when it has no such reading."""
    return F.when(value_kind.isin("integer", "int_thousands", "decimal"), value)


def br_text(value: Column, value_kind: Column) -> Column:
    """The value spelled with a decimal point, as the Brazilian reading takes it: ``1.234,5`` is ``1234.5``."""
    return F.when(value_kind == "integer", value).when(
        value_kind.isin("int_thousands", "decimal_br"), from_brazilian(value)
    )


def from_brazilian(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def number(text: Column) -> Column:
    """The decimal to ten places, or NULL when it is not a number or needs more than 28 integer digits."""
    return text.try_cast(NUMBER)


def fits_number(text: Column, digits: Column, scale: Column) -> Column:
    """Whether ``number`` reads a text exactly, given its digits before and after the point."""
    return (digits <= NUMBER_DIGITS) & (scale <= NUMBER_SCALE) & ~text.rlike("[eE]")


def worked_out(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ordered_number(text: Column) -> Column:
    """A number's value as a text that sorts as the numbers do and is the same for every spelling of it.

    Sign, power of ten, and significant digits, so any number of digits is exact; negative numbers are complemented.
    ``0.digits`` times ten to the power is the value. NULL for a power of ten of 18 digits or more.
    """
    def key(parts: Column) -> Column:
        significant = F.ltrim(F.concat(parts["whole"], parts["fraction"]), F.lit("0"))
        return worked_out(significant, lambda digits: signed(parts, digits))

    def signed(parts: Column, significant: Column) -> Column:
        power = F.length(significant) - F.length(parts["fraction"]) + parts["exponent"]
        magnitude = F.concat(F.lpad((power + POWER_BIAS).cast("string"), POWER_DIGITS, "0"), F.rtrim(significant, F.lit("0")))
        complement = F.concat(F.lit("0"), F.translate(magnitude, "0123456789", "9876543210"), F.lit("~"))
        return F.when(significant == "", "1").when(parts["negative"], complement).otherwise(F.concat(F.lit("2"), magnitude))

    power_of_ten = F.regexp_replace(F.regexp_extract(text, "[eE]([+-]?0*[0-9]{1,17})$", 1), r"^\+", "")
    parts = F.struct(
        F.startswith(text, F.lit("-")).alias("negative"), F.regexp_extract(text, "^[+-]?([0-9]*)", 1).alias("whole"),
        F.regexp_extract(text, r"^[+-]?[0-9]*\.([0-9]*)", 1).alias("fraction"),
        F.when(text.rlike("[eE]"), power_of_ten.try_cast("long")).otherwise(F.lit(0).cast("long")).alias("exponent"))
    return F.when(text.isNotNull(), worked_out(parts, key))


def number_text(key: Column) -> Column:
    """The number of a key from ``ordered_number``: plain, without trailing zeros; with a power of ten where plain
    spelling would take more than ``PLAIN_DIGITS`` zeros."""
    def body(key: Column) -> Column:
        signless = F.substr(key, F.lit(2))
        restored = F.translate(F.rtrim(signless, F.lit("~")), "0123456789", "9876543210")
        return F.when(F.startswith(key, F.lit("0")), F.concat(F.lit("-"), worked_out(restored, magnitude))).otherwise(worked_out(signless, magnitude))

    def magnitude(text: Column) -> Column:
        power = F.substr(text, F.lit(1), F.lit(POWER_DIGITS)).try_cast("long") - POWER_BIAS
        return worked_out(F.struct(power.alias("power"), F.substr(text, F.lit(POWER_DIGITS + 1)).alias("digits")), spelled)

    def spelled(parts: Column) -> Column:
        power, digits = parts["power"], parts["digits"]
        # Clipped, so that no branch repeats a digit without end.
        near = F.least(F.greatest(power, F.lit(-PLAIN_DIGITS)), F.lit(PLAIN_DIGITS)).cast("int")
        size, after = F.length(digits), F.substr(digits, F.lit(2))
        scientific = F.concat(F.left(digits, F.lit(1)), F.when(after != "", F.concat(F.lit("."), after)).otherwise(""),
                              F.lit("E"), (power - 1).cast("string"))
        return (
            F.when(power != near, scientific)
            .when(near <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -near), digits))
            .when(near >= size, F.concat(digits, F.repeat(F.lit("0"), near - size)))
            .otherwise(F.concat(F.substr(digits, F.lit(1), near), F.lit("."), F.substr(digits, near + 1))))

    return F.when(key == "1", "0").when(key.isNotNull(), worked_out(key, body))


def number_key(text: Column) -> Column:
    """One key per numeric value whatever its spelling: ``7``, ``007``, ``7.0`` and ``70e-1`` share a key.

    Plain spellings are text work alone; powers of ten and very long numbers are spelled plainly first, or keep their
    sortable key where that would take too many zeros.
    """
    def stripped(plain: Column) -> Column:
        digits = F.regexp_replace(plain, r"^\+?(-?)0*([0-9]*)(?:\.([0-9]*?)0*)?$", "$1$2.$3")
        return F.when(digits == "-.", ".").otherwise(digits)

    special = text.rlike("[eE]") | (F.length(text) > PLAIN_DIGITS)
    key = ordered_number(text)
    spelled = worked_out(key, lambda k: worked_out(number_text(k), lambda t: F.when(F.contains(t, F.lit("E")), k).otherwise(stripped(t))))
    return F.when(special, F.coalesce(spelled, text)).otherwise(stripped(text))


def plain_spelling(text: Column) -> Column:
    """Whether a number is spelled without a plus, a needless or missing zero before the point, a point without
    digits, a negative zero or an exponent."""
    return text.rlike(r"^(?!-[0.]*$)-?(0|[1-9][0-9]*)(\.[0-9]+)?$")


def integer_digits(text: Column) -> Column:
    """Digits before the point without leading zeros, at least one. The exponent is ignored."""
    whole = F.regexp_extract(text, "^[+-]?0*([0-9]*)", 1)
    return F.when(text.isNotNull(), F.greatest(F.length(whole), F.lit(1)))


def fraction_digits(text: Column) -> Column:
    """Digits after the point. The exponent is ignored."""
    return F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))


def _calendar_day(year: Column, month: Column, day: Column) -> Column:
    valid_year = F.when(year != "0000", year)
    return F.concat_ws("-", valid_year, month, day).try_cast("date")


def with_date(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``date``: both calendar readings of a value and the pattern it is spelled in.

    ``struct(code, day_first, month_first, flags)``, NULL when the value is not a date. Clock digits are not
    range-checked. Built in steps, so that each pattern is matched once per value.
    """
    text = F.col(value)
    possible = F.ascii(text).between(ord("0"), ord("9")) & F.octet_length(text).between(8, 19)
    iso, other = F.col("_spelling") == "iso", F.col("_spelling") == "day_month"
    clock = F.substr(text, F.length("_day") + 2)
    first, second, third = (F.get(F.col("_parts"), F.lit(i)) for i in range(3))
    day_first, month_first = F.col("_day_first"), F.col("_month_first")

    steps = (
        df.withColumn("_spelling", F.when(possible & text.rlike(ISO_DATE), "iso")
                      .when(possible & text.rlike(DAY_MONTH_DATE), "day_month"))
        .withColumn("_day", F.when(F.col("_spelling").isNotNull(), F.regexp_extract(text, "^[0-9/.-]+", 0)))
        .withColumn("_parts", F.split("_day", "[/.-]"))
        .withColumn("_colons", F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))))
        .withColumn("_day_first", F.when(iso, _calendar_day(first, second, third))
                    .when(other, _calendar_day(third, second, first)))
        .withColumn("_month_first", F.when(iso, F.col("_day_first")).when(other, _calendar_day(third, first, second)))
    )
    colons = F.col("_colons")
    clock_code = F.when(colons == 2, CLOCK + SECONDS).when(colons == 1, CLOCK).otherwise(0)
    separator = F.regexp_extract("_day", "[/.-]", 0)
    family = F.when(iso, F.lit(ISO_CODE) + F.when(F.contains(text, F.lit("T")), T_SEPARATOR).otherwise(0))
    for mark, base in SEPARATOR_CODES.items():
        family = family.when(separator == mark, F.lit(base))
    padded = iso | ((F.length(first) == 2) & (F.length(second) == 2))
    two_digit_hour = iso | (F.length(F.substring_index(clock, ":", 1)) == 2)
    flags = (
        F.when(other & day_first.isNull(), NOT_DAY_FIRST).otherwise(0)
        + F.when(other & month_first.isNull(), NOT_MONTH_FIRST).otherwise(0)
        + F.when(padded, PADDED).otherwise(UNPADDED)
        + F.when(colons == 0, 0).when(two_digit_hour, HOUR_PADDED).otherwise(HOUR_UNPADDED)
    )
    date = F.when(
        day_first.isNotNull() | month_first.isNotNull(),
        F.struct(
            (family + clock_code).cast("int").alias("code"),
            day_first.alias("day_first"),
            month_first.alias("month_first"),
            flags.cast("int").alias("flags"),
        ),
    )
    return steps.withColumn("date", date).drop("_spelling", "_day", "_parts", "_colons", "_day_first", "_month_first")


def date_format(code: Column, month_first: Column, flags: Column) -> Column:
    """The Spark pattern for a column whose dates all share one pattern code."""
    tail = (
        F.when(code % 4 == CLOCK + SECONDS, F.lit(":mm:ss")).when(code % 4 == CLOCK, F.lit(":mm")).otherwise(F.lit(""))
    )
    iso_hour = F.when(tail == "", "").when(code % 8 >= T_SEPARATOR, "'T'HH").otherwise(" HH")
    unpadded = flags.bitwiseAND(UNPADDED) > 0
    day, month = F.when(unpadded, "d").otherwise("dd"), F.when(unpadded, "M").otherwise("MM")
    separator = F.lit("")
    for mark, base in SEPARATOR_CODES.items():
        separator = F.when((code >= base) & (code < base + FAMILY_STEP), mark).otherwise(separator)
    hour = F.when(tail == "", "").when(flags.bitwiseAND(HOUR_UNPADDED) > 0, " H").otherwise(" HH")
    spelled = F.when(month_first, F.concat_ws("", month, separator, day)).otherwise(
        F.concat_ws("", day, separator, month)
    )
    return F.when(code.isNull(), None).when(
        code < ISO_CODE + FAMILY_STEP, F.concat(F.lit("yyyy-MM-dd"), iso_hour, tail)
    ).otherwise(F.concat(spelled, separator, F.lit("yyyy"), hour, tail))


def has_clock(code: Column) -> Column:
    return F.coalesce(code % 4 >= CLOCK, F.lit(False))


def plain_number(value: Column) -> Column:
    """A decimal as text without trailing zeros: 12.5000000000 becomes 12.5."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)

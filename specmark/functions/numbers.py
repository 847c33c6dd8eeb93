"""Numbers as texts, as Python writes them: what a table of numbers gives where a text is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(value: Column) -> Column:
    """A double with its point, and with an exponent below 0.0001 and from 1e16 on; nan for NaN, and null for null.

    The digits are those of Spark's own text of a double, which has an exponent from 1e7 on and below 0.001; the point moves.
    A lambda's body is not put into generated code, which a few columns of it would make too long to be compiled.
    """
    return F.transform(F.array(value), _text)[0]


def _text(value: Column) -> Column:
    own = F.abs(value).cast("string")
    written = F.regexp_extract(own, r"E(-?[0-9]+)$", 1)
    power = F.when(written != "", written.cast("int")).otherwise(0)
    digits = F.regexp_replace(F.regexp_extract(own, "^([0-9.]+)", 1), r"\.0$|\.", "")
    padded = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    whole, fraction = F.substr(padded, F.lit(1), power + 1), F.substr(padded, power + 2)
    large = F.concat(whole, F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    mantissa = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
    size = F.abs(power).cast("string")
    shown = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.length(size), F.lit(2)), "0"))
    moved = F.when(~F.contains(own, F.lit("E")), own).when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(shown)
    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(value), "nan").when(value.isNotNull(), F.concat(sign, F.when(own == "Infinity", "inf").otherwise(moved)))

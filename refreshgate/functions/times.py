"""Time expressions over UTC epoch milliseconds; none depends on the session time zone."""
from pyspark.sql import Column, functions as F

MS_PER_MINUTE = 60_000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000


def timestamp_ms(ts: Column) -> Column:
    """TIMESTAMP -> epoch ms."""
    return F.unix_millis(ts.cast("timestamp"))


def iso_ms(text: Column) -> Column:
    """ISO-8601 text with `Z`, an offset, or neither (read as UTC) -> epoch ms."""
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.unix_millis(F.when(has_zone, text).otherwise(F.concat(text, F.lit("Z"))).cast("timestamp"))


def whole(numerator: Column, divisor: int) -> Column:
    """Integer division that stays in BIGINT."""
    return F.call_function("div", numerator, F.lit(divisor))


def minutes_before(now_ms: int, minutes: Column) -> Column:
    return F.lit(now_ms).cast("bigint") - minutes.cast("bigint") * F.lit(MS_PER_MINUTE)


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def utc_text(ms: Column) -> Column:
    """`2026-10-12 10:23:10.292 UTC`, or `none` for NULL.

    Built from integer arithmetic: date_format would render in the session time zone.
    """
    of_day = F.pmod(ms, F.lit(MS_PER_DAY))
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole(ms - of_day, MS_PER_DAY).cast("int"))
    clock = F.concat(
        _digits(whole(of_day, MS_PER_HOUR), 2), F.lit(":"),
        _digits(whole(of_day, MS_PER_MINUTE) % 60, 2), F.lit(":"),
        _digits(whole(of_day, 1000) % 60, 2), F.lit("."),
        _digits(of_day % 1000, 3))
    return F.coalesce(F.concat(day.cast("string"), F.lit(" "), clock, F.lit(" UTC")), F.lit("none"))


def age_text(age_ms: Column) -> Column:
    """`4.2 min` below two hours, `5.1 h` below two days, else `3.0 days`; one decimal, half to even."""
    minutes = age_ms / F.lit(1000.0) / F.lit(60.0)

    def shown(value, unit):
        return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit(unit))

    return (F.when(minutes < 120, shown(minutes, " min"))
            .when(minutes < 2880, shown(minutes / 60, " h"))
            .otherwise(shown(minutes / 1440, " days")))

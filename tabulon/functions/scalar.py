"""Scalar functions of the language as Spark columns.

Blank is null. Where Spark and the language differ - rounding, division by zero, null in concatenation, where counts of
boundaries are meant - the functions say what the language says.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


@dataclass(frozen=True)
class Scalar:
    least: int
    most: int
    make: Callable[..., Column]
    #: places of arguments that must be literals (or unit words) and are passed as Python values
    literal: tuple[int, ...] = ()


def text(c: Column) -> Column:
    return c.cast("string")


def number(c: Column) -> Column:
    return c.cast("double")


def concat(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *[text(p) for p in parts])


def divide(a: Column, b: Column) -> Column:
    """The operator /: in floating point, where division by zero gives an infinity or no number."""
    a, b = number(a), number(b)
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def safe_divide(a: Column, b: Column, other: Column | None = None) -> Column:
    a, b = number(a), number(b)
    return F.when(b != 0, a / F.when(b != 0, b)).when(b == 0, F.lit(None).cast("double") if other is None else number(other))


def _scaled(x: Column, n: Column, how: Callable[[Column], Column]) -> Column:
    factor = F.pow(F.lit(10.0), number(n))
    return F.signum(number(x)) * how(F.abs(number(x)) * factor) / factor


def _mod(a: Column, b: Column) -> Column:
    rest = a % F.when(b != 0, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _to_multiple(how: Callable[[Column], Column]) -> Callable[..., Column]:
    return lambda x, s=None: number(how(x)) if s is None else how(number(x) / F.when(s != 0, number(s))) * number(s)


def _weekday(d: Column, kind: int = 1) -> Column:
    if kind == 1:
        return F.dayofweek(d)
    if kind in (2, 3):
        return F.weekday(d) + (3 - kind)
    raise QueryError("emit", f"WEEKDAY type must be 1, 2 or 3, not {kind}")


def _date_diff(a: Column, b: Column, unit: str) -> Column:
    """How many boundaries of the unit lie between."""
    unit = str(unit).upper()
    months = lambda d: F.year(d) * 12 + F.month(d)
    seconds = lambda d, n: F.floor(F.unix_timestamp(d.cast("timestamp")) / n)
    match unit:
        case "DAY":
            return F.datediff(b, a)
        case "WEEK":
            return (F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7).cast("int")
        case "MONTH":
            return months(b) - months(a)
        case "QUARTER":
            return (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))
        case "YEAR":
            return F.year(b) - F.year(a)
        case "HOUR" | "MINUTE" | "SECOND":
            n = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit]
            return seconds(b, n) - seconds(a, n)
    raise QueryError("emit", f"DATEDIFF unit must be one of {', '.join(UNITS)}")


def _half_up(x: Column, n: Column) -> Column:
    """Half away from zero, on the decimal value: 1.15 is meant as it is written."""
    exact = x.cast("decimal(38,15)")
    factor = F.pow(F.lit(10.0), number(n)).cast("decimal(20,8)")
    big = F.abs(number(x)) >= 1e15
    return F.when(big, number(x)).otherwise(F.try_divide(F.call_function("round", F.try_multiply(exact, factor)).cast("double"), factor.cast("double")))


#: Tokens of date formats and what Spark calls them, longest first.
DATE_TOKENS = (("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("hh", "HH"), ("nn", "mm"), ("ss", "ss"))


def _format(x: Column, mask: str) -> Column:
    """Named formats, date tokens, and masks of 0, #, comma, dot and percent."""
    named = mask.strip().lower()
    number_mask = lambda n: f"#,##0{'.' + '0' * n if n else ''}"
    match named:
        case "general number":
            return text(x)
        case "fixed":
            return F.format_string("%.2f", number(x))
        case "standard":
            return F.format_number(number(x), number_mask(2))
        case "percent":
            return F.when(x.isNotNull(), F.concat(F.format_string("%.2f", number(x) * 100), F.lit("%")))
        case "scientific":
            return F.format_string("%.2e", number(x))
    if any(ch in named for ch in "ymdhs") and not any(ch in named for ch in "0#"):
        pattern, rest = "", mask
        while rest:
            for token, spark in DATE_TOKENS:
                if rest.lower().startswith(token):
                    # mm after hours is minutes
                    pattern += "mm" if token == "mm" and pattern.rstrip(":").endswith("HH") else spark
                    rest = rest[len(token) :]
                    break
            else:
                pattern += f"'{rest[0]}'" if rest[0].isalpha() else rest[0]
                rest = rest[1:]
        return F.date_format(x, pattern)
    if named and all(ch in "0#,.%" for ch in named):
        percent = named.endswith("%")
        body = named.rstrip("%")
        digits = len(body.split(".")[1]) if "." in body else 0
        value = number(x) * (100 if percent else 1)
        made = F.format_number(value, number_mask(digits)) if "," in body else F.format_string(f"%.{digits}f", value)
        return F.when(x.isNotNull(), F.concat(made, F.lit("%"))) if percent else F.when(x.isNotNull(), made)
    raise QueryError("emit", f"FORMAT does not know the format {mask!r}")


def _clip(n: Column) -> Column:
    return F.greatest(n.cast("int"), F.lit(0))


def _sub(t: Column, start: Column, n: Column) -> Column:
    return F.substring(text(t), start.cast("int"), _clip(n))


def _right(t: Column, n: Column | None = None) -> Column:
    n = F.lit(1) if n is None else _clip(n)
    return F.when(n > 0, F.right(text(t), n)).when(n.isNotNull(), F.when(t.isNotNull(), F.lit("")))


def _switch(x: Column, *pairs: Column) -> Column:
    out = None
    for i in range(0, len(pairs) - 1, 2):
        out = (F if out is None else out).when(x == pairs[i], pairs[i + 1])
    return out.otherwise(pairs[-1]) if len(pairs) % 2 else out


def _time(h: Column, m: Column, s: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int"))


def _unichar(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


REGISTRY: dict[str, Scalar] = {
    "ABS": Scalar(1, 1, F.abs),
    "AND": Scalar(2, 2, lambda a, b: a & b),
    "BLANK": Scalar(0, 0, lambda: F.lit(None)),
    "CEILING": Scalar(1, 2, _to_multiple(F.ceil)),
    "COALESCE": Scalar(2, 64, F.coalesce),
    "CONCATENATE": Scalar(2, 64, concat),
    "DATE": Scalar(3, 3, lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int"))),
    "DATEDIFF": Scalar(3, 3, _date_diff, literal=(2,)),
    "DATEVALUE": Scalar(1, 1, lambda x: x.cast("date")),
    "DAY": Scalar(1, 1, F.dayofmonth),
    "DIVIDE": Scalar(2, 3, safe_divide),
    "EDATE": Scalar(2, 2, lambda d, n: F.add_months(d, n.cast("int")).cast("timestamp")),
    "EOMONTH": Scalar(2, 2, lambda d, n: F.last_day(F.add_months(d, n.cast("int")))),
    "EXACT": Scalar(2, 2, lambda a, b: text(a) == text(b)),
    "EXP": Scalar(1, 1, F.exp),
    "FALSE": Scalar(0, 0, lambda: F.lit(False)),
    "FIND": Scalar(2, 2, lambda needle, hay: F.call_function("instr", text(hay), text(needle))),
    "FLOOR": Scalar(1, 2, _to_multiple(F.floor)),
    "FORMAT": Scalar(2, 2, _format, literal=(1,)),
    "HOUR": Scalar(1, 1, F.hour),
    "IF": Scalar(2, 3, lambda c, t, e=None: F.when(c, t) if e is None else F.when(c, t).otherwise(e)),
    "INT": Scalar(1, 1, lambda x: F.floor(x).cast("long")),
    "ISBLANK": Scalar(1, 1, lambda x: x.isNull()),
    "LEFT": Scalar(1, 2, lambda t, n=None: _sub(t, F.lit(1), F.lit(1) if n is None else n)),
    "LEN": Scalar(1, 1, lambda t: F.length(text(t))),
    "LN": Scalar(1, 1, F.ln),
    "LOG": Scalar(1, 2, lambda x, b=None: F.log10(x) if b is None else F.ln(x) / F.ln(b)),
    "LOWER": Scalar(1, 1, lambda t: F.lower(text(t))),
    "MID": Scalar(3, 3, _sub),
    "MINUTE": Scalar(1, 1, F.minute),
    "MOD": Scalar(2, 2, _mod),
    "MONTH": Scalar(1, 1, F.month),
    "NOT": Scalar(1, 1, lambda x: ~x),
    "NOW": Scalar(0, 0, F.current_timestamp),
    "OR": Scalar(2, 2, lambda a, b: a | b),
    "PI": Scalar(0, 0, F.pi),
    "POWER": Scalar(2, 2, lambda a, b: F.pow(number(a), number(b))),
    "QUARTER": Scalar(1, 1, F.quarter),
    "REPLACE": Scalar(4, 4, lambda t, p, n, new: F.concat_ws("", _sub(t, F.lit(1), p - 1), text(new), F.call_function("substring", text(t), (p + n).cast("int")))),
    "REPT": Scalar(2, 2, lambda t, n: F.repeat(text(t), n.cast("int"))),
    "RIGHT": Scalar(1, 2, _right),
    "ROUND": Scalar(2, 2, _half_up),
    "ROUNDDOWN": Scalar(2, 2, lambda x, n: _scaled(x, n, F.floor)),
    "ROUNDUP": Scalar(2, 2, lambda x, n: _scaled(x, n, F.ceil)),
    "SEARCH": Scalar(2, 2, lambda needle, hay: F.call_function("instr", F.lower(text(hay)), F.lower(text(needle)))),
    "SECOND": Scalar(1, 1, F.second),
    "SIGN": Scalar(1, 1, lambda x: F.signum(number(x)).cast("int")),
    "SQRT": Scalar(1, 1, F.sqrt),
    "SUBSTITUTE": Scalar(3, 3, lambda t, old, new: F.replace(text(t), text(old), text(new))),
    "SWITCH": Scalar(3, 255, _switch),
    "TIME": Scalar(3, 3, _time),
    "TODAY": Scalar(0, 0, F.current_date),
    "TRIM": Scalar(1, 1, lambda t: F.regexp_replace(F.trim(text(t)), " +", " ")),
    "TRUE": Scalar(0, 0, lambda: F.lit(True)),
    "TRUNC": Scalar(1, 2, lambda x, n=None: _scaled(x, F.lit(0) if n is None else n, F.floor)),
    "UNICHAR": Scalar(1, 1, _unichar),
    "UPPER": Scalar(1, 1, lambda t: F.upper(text(t))),
    "VALUE": Scalar(1, 1, number),
    "WEEKDAY": Scalar(1, 2, _weekday, literal=(1,)),
    "WEEKNUM": Scalar(1, 1, F.weekofyear),
    "YEAR": Scalar(1, 1, F.year),
}

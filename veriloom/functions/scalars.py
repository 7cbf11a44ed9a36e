"""Numbers, dates, times and truth values out of text, as Column expressions.

All take and give strings (numbers: doubles), never raise, and give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import fixed
from veriloom.functions.text import strip


def let(value: Column, use) -> Column:
    """use(value), with value computed once: what is written once in the plan stays small, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, each column computed once: a generator of one row, which the optimizer neither merges with what stands above nor
    pushes conditions through.  Without it long chains of expressions that use one another several times grow without measure."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _group(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where there is none or it takes no part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_number(text: Column, pattern: str = fixed.NUMBER) -> Column:
    return F.regexp_replace(_group(text, f"({pattern})", 1), ",", "").try_cast("double")


def numeric(value: Column) -> Column:
    """The first number of a text, with the sign its first character gives and the scale of a scale word anywhere in it.

    An ungrouped number counts up to its third digit ("5000" is 500): the pattern knows groups of three only.
    """

    def read(text: Column) -> Column:
        scale = F.lit(1.0)
        for word, factor in reversed(fixed.SCALES):
            scale = F.when(F.lower(text).rlike(rf"(?U)\b{word}\b"), F.lit(factor)).otherwise(scale)
        bracket, minus = text.startswith("("), text.startswith("-")
        bare = F.when(bracket, F.regexp_replace(text, r"^[()]+|[()]+$", "")).when(minus, text.substr(F.lit(2), F.length(text))).otherwise(text)
        return first_number(bare) * scale * F.when(bracket | minus, F.lit(-1.0)).otherwise(F.lit(1.0))

    return let(strip(value.cast("string")), read)


def plain_number(value: Column) -> Column:
    """What is left of digits and points, as a number: signs and exponents are lost."""
    return F.regexp_replace(value.cast("string"), r"[^0-9.]", "").try_cast("double")


def numbers_equal(a: Column, b: Column) -> Column:
    x, y = first_number(a, fixed.SIGNED_NUMBER), first_number(b, fixed.SIGNED_NUMBER)
    return F.coalesce(x == y, F.lit(False))


def number_literal(text: Column) -> Column:
    """The first number as written, with a currency sign before it."""
    return _group(text, f"({fixed.MONEY})", 1)


def longest_number_literal(text: Column) -> Column:
    """The longest number as written; the first one of several."""
    found = F.regexp_extract_all(text, F.lit(f"({fixed.MONEY})"), F.lit(1))
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return F.try_element_at(ranked, F.lit(1))["x"]


MONTH_NUMBERS = {name: i for i, month in enumerate(fixed.MONTHS, 1) for name in (month, month[:3])}


def _ymd(y: Column, m: Column, d: Column) -> Column:
    parts = F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    return let(parts, lambda p: F.when(p["m"].between(1, 12) & p["d"].between(1, 31), F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])))


def _month(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])[F.lower(name)]


def date(value: Column) -> Column:
    """YYYY-MM-DD, or the text itself if it holds no date; day before month where both could be meant; no check of month lengths."""

    def read(text: Column) -> Column:
        iso, num, day, mon = ([_group(text, p, i) for i in range(1, n + 1)] for p, n in ((fixed.ISO_DATE, 3), (fixed.NUMERIC_DATE, 6), (fixed.DAY_MONTH, 3), (fixed.MONTH_DAY, 3)))
        numbers = F.when(num[0].isNotNull(), _ymd(*num[:3])).otherwise(_ymd(num[5], num[4], num[3]))
        return F.coalesce(_ymd(*iso), numbers, _ymd(day[2], _month(day[1]), day[0]), _ymd(mon[2], _month(mon[0]), mon[1]), text)

    return let(F.nullif(strip(value.cast("string")), F.lit("")), read)


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    parts = F.struct(hour.cast("int").alias("h"), F.coalesce(minute.cast("int"), F.lit(0)).alias("m"), F.upper(F.coalesce(half, F.lit(""))).alias("half"))

    def shown(p: Column) -> Column:
        h = F.when((p["half"] == "AM") & (p["h"] == 12), F.lit(0)).when((p["half"] == "PM") & (p["h"] != 12), p["h"] + 12).otherwise(p["h"])
        return F.when(h.between(0, 23) & p["m"].between(0, 59), F.format_string("%02d:%02d", h, p["m"]))

    return let(parts, shown)


def time(value: Column) -> Column:
    """HH:MM or HH:MM-HH:MM, or the text itself if neither can be read."""
    both = f"(?iU){fixed.CLOCK}{fixed.CLOCK_SEPARATOR}{fixed.CLOCK}"
    one = f"(?U){fixed.CLOCK}"

    def read(text: Column) -> Column:
        iso = _clock(_group(text, fixed.ISO_CLOCK, 1), _group(text, fixed.ISO_CLOCK, 2), F.lit(None).cast("string"))
        start, end = (_clock(*[_group(text, both, i + k) for k in range(3)]) for i in (1, 4))
        return F.coalesce(iso, F.concat(start, F.lit("-"), end), _clock(*[_group(text, one, i) for i in (1, 2, 3)]), text)

    return let(F.nullif(strip(value.cast("string")), F.lit("")), read)


def boolean(value: Column) -> Column:
    """True, false, or null for what is neither."""
    word = F.lower(strip(value.cast("string")))
    return F.when(word.isin(*fixed.TRUE_WORDS), F.lit(True)).when(word.isin(*fixed.FALSE_WORDS), F.lit(False))


def fact_type(value: Column) -> Column:
    word = F.lower(strip(value.cast("string")))
    return F.when(word.isin(*fixed.FACT_TYPES), word).otherwise(F.lit("semantic"))


def confidence(stated: Column, score: Column) -> Column:
    """The smaller of the stated confidence (0.6 if unreadable), kept within 0 and 1, and the grounding score; two places."""
    own = F.least(F.greatest(F.coalesce(stated.try_cast("double"), F.lit(0.6)), F.lit(0.0)), F.lit(1.0))
    return F.bround(F.least(own, score / 100.0), 2)

"""Column functions with the semantics the claims data was made under: loose truth, numeric prefixes, rounding, null order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ACTIVE_LABEL, CLEAN_LABEL

NUMBER_PREFIX = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def has_text(c: Column) -> Column:
    """Not null and not empty. An array or object stored as JSON text, also `[]`, counts as there."""
    return F.coalesce(c != "", F.lit(False))


def has_number(c: Column) -> Column:
    """Not null, not zero, not NaN."""
    return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))


def once(value: Column, body) -> Column:
    """body(value), where value is evaluated once for a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or(c: Column, *others: Column) -> Column:
    """The first that has text; else the last."""
    *some, last = [c, *others]
    return F.coalesce(*[F.when(has_text(x), x) for x in some], last)


def number_or(c: Column, other: Column) -> Column:
    return F.when(has_number(c), c).otherwise(other)


def parse_float(c: Column) -> Column:
    """The number a text begins with, else 0: '12.5abc' is 12.5."""
    return F.coalesce(F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))


def number(c: Column) -> Column:
    """The whole text as a number; 0 for null, empty and other text."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def trimmed(c: Column) -> Column:
    """Trimmed text, null when empty."""
    return F.nullif(F.trim(c), F.lit(""))


def round_half_up(c: Column) -> Column:
    """To an integer, halves toward plus infinity: 2.5 to 3 and -2.5 to -2."""
    return F.floor(c + 0.5)


def ordinal(c: Column, members: list[str]) -> Column:
    """Place of an enum value in its declared order; unknown values come last, null stays null."""
    chain = reduce(lambda w, m: w.when(c == m[1], m[0]), enumerate(members[1:], 1), F.when(c == members[0], 0))
    return chain.when(c.isNotNull(), len(members))


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def any_ilike(columns: list[Column], words: list[str], escape: bool = False) -> Column:
    """Case-insensitive substring search. `%` and `_` are wildcards unless escaped."""
    safe = lambda w: w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escape else w
    return reduce(lambda a, b: a | b, [c.ilike(f"%{safe(w)}%") for w in words for c in columns])


def lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), default)


def pad2(c: Column) -> Column:
    """Two digits at least; longer numbers stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def dash(c: Column) -> Column:
    return text_or(c, F.lit("—"))


def shekels(c: Column, digits: int = 2) -> Column:
    """Grouped, with the currency sign in front."""
    return F.concat(F.lit("₪"), F.format_number(c, digits))


def to_fixed(c: Column, digits: int) -> Column:
    """A decimal number's text with so many decimals, halves away from zero, not grouped."""
    return c.cast(f"decimal(38,{digits})").cast("string")


def amount_label(c: Column) -> Column:
    """Whether there is an amount, in words."""
    return F.when(c > 0, ACTIVE_LABEL).otherwise(CLEAN_LABEL)


def latest_first(items: Column) -> Column:
    """An array from its end."""
    return F.reverse(items)


def stamped(c: Column, now: Column | None = None) -> Column:
    """c, where it is null the present time, which tests give as `now`."""
    return F.coalesce(c, F.current_timestamp() if now is None else now)


def strip_fences(c: Column) -> Column:
    """Text-model output without its code fences."""
    return F.trim(F.regexp_replace(c, "```json|```", ""))


def outer_array(c: Column) -> Column:
    """From the first `[` to the last `]`, over lines; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit(""))


def without_attribution(c: Column, patterns: list[str]) -> Column:
    """c without the patterns, trimmed; c itself if nothing is left."""
    return text_or(F.trim(reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)), c)


def segments(code: Column) -> Column:
    """Parts between dots; trailing empty ones stay."""
    return F.split(code, "[.]", -1)


def first_segments(code: Column, n: int) -> Column:
    return F.array_join(F.slice(segments(code), 1, n), ".")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name without one."""
    return F.lower(F.element_at(F.split(name, "[.]", -1), -1))


def string_bucket(c: Column, n: int) -> Column:
    """A 32-bit rolling string hash (h = 31 h + code), its magnitude modulo n."""
    codes = F.transform(F.filter(F.split(c, "", -1), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x) % F.lit(1 << 32))
    return F.abs(F.when(h >= 1 << 31, h - F.lit(1 << 32)).otherwise(h)) % n

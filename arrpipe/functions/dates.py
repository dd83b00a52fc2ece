"""Mixed-format date text to date, month first, by a fixed set of shapes."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Month names in calendar order.
_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
_MONTH = "(" + "|".join(f"{m}|{m[:3]}" for m in _MONTHS) + r"|sept)\.?"
_DAY, _YEAR = r"([0-9]{1,2})(?:st|nd|rd|th)?(?:\s+of)?", "([0-9]{4})"
_GAP, _START, _END = r"(?:\s+|\s*-\s*)", r"(?<![\p{L}0-9])", r"(?![\p{L}0-9])"
# Shapes with the meaning of their groups: year, month, day, or n, a number before a day that is
# the month unless it can't be. A full date may stand anywhere in the text: the leftmost one decides,
# valid or not. In order: 2024-3-5, 3/5/2024 or 3/5/24, March 5, 2024, 5 March 2024, 2024 March 5, 20240305.
_FULL = (
    (r"(?<![0-9])([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?![0-9])", "ymd"),
    (r"(?<![0-9])(?<![0-9][.])([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})(?![0-9])(?![.][0-9])", "ndy"),
    (rf"{_START}{_MONTH}{_GAP}{_DAY},?{_GAP}{_YEAR}{_END}", "mdy"),
    (rf"{_START}{_DAY}{_GAP}{_MONTH},?{_GAP}{_YEAR}{_END}", "dmy"),
    (rf"{_START}{_YEAR}{_GAP}{_MONTH}{_GAP}{_DAY}{_END}", "ymd"),
    (r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", "ymd"),
)
# A partial date must be the whole text: March 2024, 2024, 5 March, March 5, 2024-03, 03/2024. A month with
# a year may also stand inside a text that has no full date.
_PARTIAL = (
    (_YEAR, "y"), (rf"{_DAY}\s+{_MONTH}", "dm"), (rf"{_MONTH}\s+{_DAY}", "md"),
    (r"([0-9]{4})[-/.]([0-9]{1,2})", "ym"), (r"([0-9]{1,2})[-/.]([0-9]{4})", "my"),
)
_INSIDE = ((rf"{_START}{_MONTH},?{_GAP}{_YEAR}{_END}", "my"),)


def _either(shapes: tuple) -> str:
    return "|".join(shape for shape, _ in shapes)


_SHAPES = rf"(?is)^(?:.*?(?:{_either(_FULL)}).*|\s*(?:{_either(_PARTIAL)})\s*|.*?(?:{_either(_INSIDE)}).*)\z"


def _groups(kinds: str) -> str:
    """References to all groups of the kinds; those of shapes that did not match are empty."""
    meaning = "".join(letters for _, letters in (*_FULL, *_PARTIAL, *_INSIDE))
    return "".join(f"${i}" for i, letter in enumerate(meaning, 1) if letter in kinds)


# Year, month, day and, where month and day may be swapped, a non-empty mark.
_PARTS = r"\u0001".join(("", _groups("y"), _groups("mn"), _groups("d"), _groups("n")))


def parse_date_sql(x: str, as_of: str) -> str:
    names = "".join(m[:3] for m in _MONTHS)
    # Two digits name the year within fifty years of ``as_of``.
    near = f"(year({as_of}) div 100 * 100 + int(p[1]))"
    century = f"{near} + case when {near} >= year({as_of}) + 50 then -100 when {near} < year({as_of}) - 50 then 100 else 0 end"
    year = f"case length(p[1]) when 0 then year({as_of}) when 2 then {century} else int(p[1]) end"
    month = (
        f"case when p[2] = '' then month({as_of}) when p[2] rlike '^[0-9]' then int(p[2]) "
        f"else int((instr('{names}', lower(left(p[2], 3))) + 2) div 3) end"
    )

    def date(month: str, day: str) -> str:
        # Text to date, as ``make_date`` would fail on the 30th of February.
        return f"try_cast(concat_ws('-', lpad(q.y, 4, '0'), {month}, {day}) as date)"

    # Without a day, that of ``as_of``, or the last of a shorter month.
    first = date("q.m", "1")
    clipped = f"date_add({first}, least(day({as_of}), day(last_day({first}))) - 1)"
    swapped = f"case when p[4] <> '' then {date('int(p[3])', 'q.m')} end"
    value = (
        f"case when q.y = 0 then null when p[3] = '' then {clipped} "
        f"else coalesce({date('q.m', 'int(p[3])')}, {swapped}) end"
    )
    fields = let("q", f"named_struct('y', {year}, 'm', {month})", value)
    parts = rf"split(regexp_replace({x}, r'{_SHAPES}', '{_PARTS}'), '\u0001')"
    return let("p", parts, f"case when size(p) = 5 then {fields} end")


def parse_date(col: str, as_of: dt.date) -> Column:
    """The date in ``col``, or NULL; ``as_of`` supplies parts a partial date lacks."""
    return F.expr(parse_date_sql(col, f"date'{as_of.isoformat()}'"))

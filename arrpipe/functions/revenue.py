"""Free-text revenue to (currency, exact amount, minimum, maximum)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Symbols in order of precedence, codes, and unit multipliers.
_SYMBOLS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"))
_CODE = r"(?i)(USD|EUR|GBP|JPY)(?![\p{L}\p{N}_])"
_UNITS = {
    "b": "1e9", "bn": "1e9", "billion": "1e9",
    "m": "1e6", "mm": "1e6", "million": "1e6",
    "k": "1e3", "thousand": "1e3",
}
_WS = r"[\s\x1c-\x1f\x85\p{Z}]"
_BLANKS = (
    r" \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    r"\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_LONGEST_FIRST = "|".join(sorted(_UNITS, key=lambda unit: (-len(unit), unit)))
_AMOUNT = rf"(?i)([0-9.]+){_WS}*({_LONGEST_FIRST})?"


def _without_currency(x: str) -> str:
    """Drop the first symbol kind present; with no symbol, the first code. Then drop all codes."""
    whens = " ".join(
        f"when contains({x}, '{symbol}') then replace({x}, '{symbol}', '')"
        for symbol, _ in _SYMBOLS
    )
    first_code = rf"regexp_replace({x}, r'(?s)^(.*?){_CODE}', '$1')"
    return f"replace(regexp_replace(case {whens} else {first_code} end, r'{_CODE}', ''), ',', '')"


def _amount(x: str) -> str:
    factors = ", ".join(f"'{unit}', {factor}D" for unit, factor in _UNITS.items())
    number = f"try_cast(regexp_extract(plain, r'{_AMOUNT}', 1) as double)"
    unit = f"lower(regexp_extract(plain, r'{_AMOUNT}', 2))"
    factor = f"coalesce(try_element_at(map({factors}), {unit}), 1D)"
    return let("plain", _without_currency(x), f"{number} * {factor}")


def parse_revenue_sql(x: str) -> str:
    text = f"trim(both '{_BLANKS}' from {x})"
    whens = " ".join(f"when contains(txt, '{s}') then '{code}'" for s, code in _SYMBOLS)
    currency = f"case {whens} else nullif(upper(regexp_extract(txt, r'{_CODE}', 1)), '') end"
    sides = (
        "case when contains(txt, ' - ') then array(substring_index(txt, ' - ', 1), "
        "substr(txt, instr(txt, ' - ') + 3)) else array(txt) end"
    )
    parsed = let(
        "txt", text,
        f"named_struct('cur', {currency}, 'amts', transform({sides}, side -> {_amount('side')}))",
    )
    ok = "r.cur is not null and forall(r.amts, a -> a is not null)"
    return let(
        "r", parsed,
        f"named_struct('currency', case when {ok} then r.cur end, "
        f"'actual', case when {ok} and size(r.amts) = 1 then r.amts[0] end, "
        f"'min', case when {ok} and size(r.amts) = 2 then array_min(r.amts) end, "
        f"'max', case when {ok} and size(r.amts) = 2 then array_max(r.amts) end)",
    )


def parse_revenue(col: str) -> Column:
    """struct(currency, actual, min, max); all NULL when currency or an amount is missing."""
    return F.expr(parse_revenue_sql(col))

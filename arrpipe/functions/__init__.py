from .dates import parse_date
from .names import aliases, compact, initials, normal, synonyms
from .numbers import to_int
from .registry import register
from .revenue import parse_revenue

__all__ = [
    "aliases", "compact", "initials", "normal", "parse_date", "parse_revenue",
    "register", "synonyms", "to_int",
]

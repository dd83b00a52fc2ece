"""Helper for SQL expression text."""


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, so that a long value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"

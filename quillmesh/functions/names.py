"""Column names that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def spare(base: str, *taken: Iterable[str]) -> str:
    """base, with as many underscores behind it as no taken name, in any case, has."""
    used = {name.lower() for names in taken for name in names}
    while base.lower() in used:
        base += "_"
    return base

"""Errors found in input files."""

from __future__ import annotations

from pyspark.sql import DataFrame

SHOWN = 20


class InputError(ValueError):
    """Holds (line number or None, message) of the first errors."""

    def __init__(self, errors: list[tuple[int | None, str]]):
        self.errors = errors
        super().__init__("\n".join(f"line {n}: {m}" if n is not None else m for n, m in errors))


def raise_if_any(errors: DataFrame) -> None:
    """errors: (line_no, message)."""
    found = errors.orderBy("line_no").limit(SHOWN).collect()
    if found:
        raise InputError([(r.line_no, r.message) for r in found])

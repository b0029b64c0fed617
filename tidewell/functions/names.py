"""Quoted and qualified identifiers."""

from __future__ import annotations


def quote(identifier: str, mark: str = "`") -> str:
    """Quote one identifier part, doubling any quote mark inside it."""
    return f"{mark}{identifier.replace(mark, mark * 2)}{mark}"


def qualified(*parts: str, mark: str = "`") -> str:
    """Join the non-empty parts of a name, each one quoted."""
    return ".".join(quote(part, mark) for part in parts if part)


def raw_table_name(catalog: str | None, schema: str, source_table: str) -> str:
    """Name of the raw-layer table a source table lands in (lower-cased)."""
    return qualified(catalog or "", schema, source_table.lower())

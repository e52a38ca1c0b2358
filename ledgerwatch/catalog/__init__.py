"""All named queries."""

from __future__ import annotations

from ledgerwatch.catalog import bank, books, detection, governed, measures
from ledgerwatch.catalog.registry import Registry


def build_registry() -> Registry:
    reg = Registry()
    for part in (detection, books, governed, measures, bank):
        part.register(reg)
    return reg

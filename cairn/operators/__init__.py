"""Catalogs, their indices and queries."""

from cairn.operators.catalog import Catalog
from cairn.operators.indices import EqualityIndex, GraphIndex, Hook, MultiIndex, SortedIndex, View, many, path, simple
from cairn.operators.snapshot import Snapshot

__all__ = ["Catalog", "EqualityIndex", "GraphIndex", "Hook", "MultiIndex", "Snapshot", "SortedIndex", "View", "many", "path", "simple"]

"""Errors that callers can tell apart."""


class CatalogError(Exception):
    """Any error of a catalog, an engine or a connector."""


class IndexNotFound(CatalogError):
    """A query names an index that the catalog doesn't have."""


class UnsupportedIndexOperation(CatalogError):
    """A range or text predicate on an index that isn't sorted, or whose keys aren't text."""


class IndexKeyLimitExceeded(CatalogError):
    """A row has more composite keys than its graph index allows."""


class CatalogNotAvailable(CatalogError):
    """The catalog failed to load and has no snapshot to serve."""


class UncoveredConditions(CatalogError, NotImplementedError):
    """No hotpath covers all fields of a graph query."""


class SnapshotCorrupt(CatalogError):
    """A stored snapshot whose files don't fit its manifest."""

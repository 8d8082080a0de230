"""Errors of the table layer and of structured queries; callers tell them apart by class, never by text."""


class TarnError(Exception):
    """Any error raised by this package."""


class TableExists(TarnError):
    pass


class TableNotFound(TarnError):
    pass


class VersionNotFound(TarnError):
    pass


class VersionConflict(TarnError):
    """Another commit took the version; a retry must start from the new one."""


class FileValidation(TarnError):
    """A commit adds or removes files that it cannot."""


class SchemaError(TarnError):
    pass


class FilterError(TarnError):
    pass


class QueryError(TarnError):
    pass


class TransactionError(TarnError):
    """A transaction that has ended, timed out or is unknown."""

"""Errors that users see."""


class TidemarkError(Exception):
    """Any error of this library."""


class UserInputError(TidemarkError):
    """A query or argument makes no sense."""


class SchemaError(TidemarkError):
    """Columns or types don't fit together."""


class UnsortedDataError(TidemarkError):
    """Rows are not in the order of their index, or overlap."""


class NoSuchVersionError(TidemarkError):
    """The symbol, version or snapshot does not exist."""


class LibraryNotFoundError(TidemarkError):
    """The library does not exist."""


class DuplicateKeyError(TidemarkError):
    """Several source rows of a merge match one target row."""

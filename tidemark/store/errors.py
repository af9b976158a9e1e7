"""What can go wrong in the store."""


class TidemarkError(Exception):
    """The base of all errors of the store."""


class DataIntegrityError(TidemarkError):
    """Keys or rows would become inconsistent."""


class ItemNotFoundError(TidemarkError, ValueError):
    """No such item."""


class ItemExistsError(TidemarkError, ValueError):
    """An item of that name exists."""


class CollectionNotFoundError(TidemarkError, ValueError):
    """No such collection."""


class CollectionExistsError(TidemarkError, ValueError):
    """A collection of that name exists."""


class SnapshotNotFoundError(TidemarkError, ValueError):
    """No such snapshot."""


class StorageError(TidemarkError):
    """Data could not be written or read."""


class SchemaError(TidemarkError):
    """A schema may not change in this way."""


class ConfigurationError(TidemarkError):
    """A setting is missing or wrong."""


class ValidationError(TidemarkError):
    """Data don't satisfy a rule."""


class TransactionError(StorageError):
    """A transaction failed or is over."""

"""Errors raised while a plan is being built."""


class RecordError(ValueError):
    """Base of all errors of this package."""


class InvalidQuery(RecordError):
    """A filter term, sort or page request that the column cannot answer."""


class InvalidName(RecordError):
    """An attribute or record type name with characters or a prefix not allowed."""


class InvalidRelation(RecordError):
    """A relation that contradicts the table's schema."""


class InvalidTsv(RecordError):
    """A tab-separated file whose header or keys cannot be used."""


class UnsupportedConversion(RecordError):
    """A pair of types between which values are never converted."""


class MissingObject(RecordError):
    """A record, attribute or record type that does not exist."""


class Conflict(RecordError):
    """A request that contradicts existing data."""

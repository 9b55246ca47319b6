"""Errors that callers may want to tell apart. Where the library can go on, they are caught and told in a column."""


class SablefinError(Exception):
    """Base of this library's own errors; ``retryable`` tells whether trying again may help."""

    retryable = False


class PatternError(SablefinError):
    """A regex that does not compile."""


class SourceError(SablefinError):
    """A source that cannot be read, or has no such table."""


class ConfigError(SourceError):
    """A setting that is missing or makes no sense."""


class ColumnError(SablefinError, KeyError):
    """Columns that are not there, or of the wrong type."""


class ValidationError(SablefinError, ValueError):
    """Values that an operator does not take."""


class DimensionError(ValidationError):
    """Vectors of another length than an index or query has."""


class DictionaryError(SablefinError):
    """A token dictionary that does not fit the records."""


class SealError(SablefinError):
    """A sealed value that does not open with the key."""


class ModelError(SablefinError):
    """A model that gives no or too few answers."""


class ScorerError(SablefinError):
    """An outside scorer that fails."""

    retryable = True


class RateLimitError(ScorerError):
    """An outside scorer that asks to wait ``retry_after`` seconds."""

    def __init__(self, message: str = "too many calls", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class TimeoutExceeded(ScorerError):
    """An outside scorer that does not answer in time."""


class CancelledError(SablefinError):
    """A run that was cancelled."""


class StoreError(SablefinError):
    """A run store that cannot be read or written."""


class StreamRowError(SablefinError):
    """A row of a stream that fails a check, where such rows are not set aside."""

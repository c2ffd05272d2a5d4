"""Typed errors for conditions that stop an operation before any output."""

from __future__ import annotations

from tamis import fixed


class TamisError(Exception):
    """Base class of all errors raised by this package."""


class PathNotFound(TamisError):
    def __init__(self, path: str):
        self.path = path
        super().__init__(fixed.ERROR_PATH.format(path))


class NoSupportedFiles(TamisError):
    def __init__(self, directory: str):
        self.directory = directory
        super().__init__(fixed.ERROR_NO_FILES.format(directory))


class UnknownCategory(TamisError):
    """An extra detector gave issues of a category that reports do not know."""

    def __init__(self, category: str | None):
        super().__init__(f"Unknown issue category: {category!r}")
        self.category = category


class FileTooLarge(TamisError):
    def __init__(self, path: str, limit_bytes: int, actual_bytes: int):
        self.path, self.limit_bytes, self.actual_bytes = path, limit_bytes, actual_bytes
        super().__init__(fixed.ERROR_SIZE.format(path, limit_bytes, actual_bytes))


class UnrepresentableValue(TamisError):
    """A value has no faithful form in the export format; nothing was written."""

    def __init__(self, record_index: int, field_name: str, fmt: str):
        self.record_index, self.field_name, self.fmt = record_index, field_name, fmt
        super().__init__(fixed.ERROR_VALUE.format(field_name, record_index, fmt))


class MixedTypes(TamisError):
    """A field holds more than one type, so it has no Parquet column type."""


class ReportFailed(TamisError):
    def __init__(self, fmt: str, detail: str):
        self.fmt, self.detail = fmt, detail
        super().__init__(fixed.ERROR_REPORT.format(fmt, detail))


class UnsupportedFormat(TamisError):
    def __init__(self, fmt: object):
        self.fmt = fmt
        super().__init__(fixed.ERROR_FORMAT.format(str(fmt)))


class InvalidSchema(TamisError):
    """A declared schema could not be read."""

"""Errors of the library. Operators that work on many documents return them as a struct instead of raising."""

from __future__ import annotations

#: Schema of the outcome of one document in a batch.
OUTCOME = "ok boolean, error_type string, error_code int, error string"


class SliceError(Exception):
    """A document that cannot be sliced; code follows HTTP: 400 for input that is refused, 500 for a parser that failed."""

    code = 500

    def __init__(self, message: str, code: int | None = None) -> None:
        super().__init__(message)
        self.code = self.code if code is None else code


class UnsupportedFormat(SliceError):
    code = 400


class ParseFailure(SliceError):
    code = 500


class LimitExceeded(Exception):
    """A document went over one of the ParserLimits."""

    code = 413

"""Errors, raised before a plan is submitted wherever that is possible."""


class LodeError(Exception):
    """Base of all errors of this package."""


class DimensionMismatch(LodeError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected {expected} dimensions, got {actual}")
        self.expected, self.actual = expected, actual


class NotFound(LodeError):
    pass


class AlreadyExists(LodeError):
    pass


class InvalidConfig(LodeError):
    pass


class FulltextNotEnabled(InvalidConfig):
    pass


class InvalidFilter(LodeError):
    pass


class InvalidVector(LodeError):
    pass


class CorruptLog(LodeError):
    pass

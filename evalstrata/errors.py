"""Errors with a hint for the user, and the exit codes of the command line."""

from __future__ import annotations

OK, FAILED, MISUSED = 0, 1, 2


class StrataError(Exception):
    """Base of all errors raised on purpose."""

    exit_code = FAILED

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.message, self.hint = message, hint

    def __str__(self) -> str:
        return self.message if not self.hint else f"{self.message} {self.hint}"


class ConfigError(StrataError):
    """Settings or arguments that can't be used."""

    exit_code = MISUSED


class DatasetError(StrataError):
    """A dataset file that can't be read or has a bad line."""


class RunError(StrataError):
    """A run log or manifest that can't be used."""


class BackendError(StrataError):
    """A model backend that failed for one request."""


class RunAborted(StrataError):
    """Too many failures in a row."""


class AudioError(StrataError):
    """Audio that can't be read."""

"""Failures by exit code: 2 usage, 3 pre-flight, 4 input/output, 5 data, 6 verification."""

from __future__ import annotations


class EngineError(Exception):
    code = 1


class UsageError(EngineError):
    code = 2


class PreflightError(EngineError):
    code = 3


class InputOutputError(EngineError):
    code = 4


class DataError(EngineError):
    code = 5


class VerifyError(EngineError):
    code = 6


#: Starts the message of every ``raise_error`` of a key expression.
DATA_MARK = "collatrix data error: "


def as_engine_error(error: Exception) -> Exception:
    """A Spark failure that a key expression raised, as the data error it stands for."""
    text = str(error)
    if DATA_MARK in text:
        return DataError(text[text.index(DATA_MARK) + len(DATA_MARK) :].splitlines()[0].rstrip("'\""))
    return error

"""Errors by kind, each with the exit code that a command ends with."""

from __future__ import annotations


class PipelineError(Exception):
    """Base of all errors that a user should see."""


class ConfigError(PipelineError):
    pass


class DownloadError(PipelineError):
    pass


class ExtractError(PipelineError):
    pass


class OCRError(PipelineError):
    pass


class ConverterError(PipelineError):
    pass


class TranslateError(PipelineError):
    pass


class RenderError(PipelineError):
    pass


class JobError(PipelineError):
    pass


# Exit codes by kind; other errors end with 1.
EXIT_CODES = ((ConfigError, 2), (DownloadError, 3), (ExtractError, 4), (OCRError, 4), (ConverterError, 4), (TranslateError, 5), (RenderError, 6), (JobError, 7))


def exit_code(error: BaseException) -> int:
    return next((code for kind, code in EXIT_CODES if isinstance(error, kind)), 1)

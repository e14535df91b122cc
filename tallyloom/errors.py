"""Errors that say what is wrong with the input; the command line prints them and exits with 2."""

from __future__ import annotations


class TallyloomError(Exception):
    """A problem with the user's input, configuration or data."""


class ConfigError(TallyloomError, ValueError):
    pass


class ManifestError(TallyloomError, ValueError):
    pass


class QuestionError(TallyloomError, ValueError):
    pass


class EvalError(TallyloomError, ValueError):
    pass


class SamplingError(TallyloomError, ValueError):
    pass


class LayoutError(TallyloomError, RuntimeError):
    pass


class MediaError(TallyloomError, RuntimeError):
    pass


class _Named(TallyloomError, KeyError):
    def __str__(self) -> str:
        return str(self.args[0])


class PromptError(_Named):
    pass


class UnknownExperiment(_Named):
    pass

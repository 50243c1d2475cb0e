"""Errors a caller may want to tell apart."""


class QuillError(Exception):
    """Any expected failure."""


class ConfigurationError(QuillError):
    """An option is out of range or contradicts another."""


class CorpusError(QuillError):
    """The corpus is missing, unreadable, changed meanwhile, or empty after cleaning."""


class ModelError(QuillError):
    """A stored model is missing, incomplete, or of another version."""


class GenerationError(QuillError):
    """No text can be generated for this prompt."""

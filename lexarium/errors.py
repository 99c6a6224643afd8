"""What can go wrong with a lexicon, by kind."""

from __future__ import annotations


class LexiconError(Exception):
    """Any failure of this package."""


class NotFound(LexiconError, FileNotFoundError):
    """A file or folder is missing."""


class InvalidFormat(LexiconError, ValueError):
    """Bytes are not what their format asks for."""


class Unsupported(LexiconError):
    """A format, codec or request that this package does not handle."""


class IndexMissing(LexiconError):
    """A key or index that is not there."""


class DecompressionFailed(LexiconError):
    """A compressed stream is broken or grows beyond its limit."""


class ChecksumMismatch(LexiconError):
    """Stored and computed checksums differ."""

"""The adaptor onto the synthetic tables and the catalogue of queries."""

from . import catalogue, evaluation  # noqa: F401

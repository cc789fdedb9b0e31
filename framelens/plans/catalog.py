"""Imports every query module, so that the registry is complete."""

from . import q_classify, q_pages, q_select, q_stream, q_tables, q_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""Imports every operator of the subpackage, so that its registry is complete."""

from . import decontamination, embeddings, fingerprints, language, lm, mixing, pieces, prefixes, runs, simhash, substrings, toxicity, warc  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

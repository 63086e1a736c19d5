"""Imports every query module, so that all register themselves."""

from lumengraph.plans import activity, discover, notes, vault, vectors  # noqa: F401
from lumengraph.plans.catalog import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "vector_topk"

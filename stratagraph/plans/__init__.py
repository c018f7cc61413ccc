"""Registered queries; importing a module of this package registers its queries."""

from stratagraph.plans import graphs, network, series  # noqa: F401
from stratagraph.plans.registry import ORACLES, QUERIES  # noqa: F401

"""All registered queries with their SQL."""

from fixmine.queries import candidates, evaluation, history, linking, localisation, lookups, network, records, scalars, shaping, sources, workflows  # noqa: F401  they register themselves
from fixmine.queries.base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "vote_modes"

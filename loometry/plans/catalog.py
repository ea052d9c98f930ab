"""All registered queries."""

from loometry.plans import keyed, localize, media, runs, sheets, sql, streams, upkeep, usage  # noqa: F401
from loometry.plans.registry import ORACLE, QUERIES  # noqa: F401

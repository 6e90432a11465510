"""All registered queries: importing the groups fills the registry."""

from rolecall.checks.registry import BUILDERS, ORACLES, run  # noqa: F401
from rolecall.checks import (  # noqa: F401
    lookups, listings, state_of_tables, cleaning, merging, state_folds, reports_of_runs,
    extraction, composites,
)

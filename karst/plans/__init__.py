"""All registered queries."""

from karst.plans import curation, evaluation, telemetry
from karst.plans.catalog import PLANS, SQL

__all__ = ["PLANS", "SQL", "curation", "evaluation", "telemetry"]

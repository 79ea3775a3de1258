"""The registered queries."""

from sitelore.plans import eval_jobs, log_jobs, page_jobs, relational, search_jobs, storage_jobs  # noqa: F401
from sitelore.plans.registry import ORACLES, PLANS, Data

__all__ = ["ORACLES", "PLANS", "Data"]

from .bands import Band, eq, ge, le, lt
from .outcomes import outcome, outcome_group
from .stats import mean, missing, pct_error, round_to, safe_corr, share_pct

__all__ = [
    "Band", "eq", "ge", "le", "lt",
    "outcome", "outcome_group",
    "mean", "missing", "pct_error", "round_to", "safe_corr", "share_pct",
]

from . import evaluation, intake, messages, models, preparation, profiling, reduction, segments  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Trip chaining and origin-destination imputation for smart-card taps, on Spark."""

from tripchain.config import Config
from tripchain.plans.day import run, write_results

__all__ = ["Config", "run", "write_results"]

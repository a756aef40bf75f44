"""A Spark-native analytics engine for semi-structured log lines."""

from .engine import LogEngine, compress, run_query
from .functions.patterns import PATTERNS, Pattern, Registry

__all__ = ["PATTERNS", "LogEngine", "Pattern", "Registry", "compress", "run_query"]
__version__ = "0.1.0"

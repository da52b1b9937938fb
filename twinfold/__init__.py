"""Entity resolution on Spark: find, score, cluster and merge records that mean the same."""

from .operators.blocking import BlockingRule
from .operators.compare import Comparison
from .operators.model import Model, Settings
from .plans.configure import auto_configure
from .plans.resolve import Resolution, check_incoming, resolve, write_results
from .sources.package import ship_package

__all__ = [
    "BlockingRule", "Comparison", "Model", "Resolution", "Settings", "auto_configure",
    "check_incoming", "resolve", "ship_package", "write_results",
]

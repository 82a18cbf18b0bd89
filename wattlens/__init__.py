"""wattlens: capacity-expansion study results as Spark DataFrame jobs.

Entry points: ``sources`` (symbol scans and sinks), ``plans`` (mart, statistics and figure
jobs), ``streaming`` (incremental mart builds), ``catalog`` (jobs bound to the driver tables).
"""

__version__ = "0.1.0"

"""tidemill: a PySpark-native analytics engine for transaction data.

Subpackages: ``operators`` (DataFrame -> DataFrame operators), ``sources`` (readers,
sinks, the tolerant record loader), ``functions`` (column expressions), ``plans``
(named queries with their SQL), ``streaming`` (Structured Streaming variants).
"""

__version__ = "0.1.0"

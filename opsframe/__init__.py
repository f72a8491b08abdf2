"""opsframe: Spark-native analytics for data-platform operations.

Every core takes and returns DataFrames built from Catalyst expressions; jobs in
``opsframe.plans`` compose them and are the only place that reads or writes.
"""

__version__ = "0.1.0"

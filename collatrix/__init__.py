"""collatrix: ordered-data preparation on Apache Spark.

Scans, typed sort keys, ordering, duplicate removal, Top-N, verification, profiling,
conversion and ordered sinks, expressed with DataFrames and Catalyst.
"""

__version__ = "0.1.0"

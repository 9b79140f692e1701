"""tabwright: Spark-native preparation, profiling and classification of large tables.

Every operator is a plain function from DataFrame(s) to DataFrame, built from Catalyst
expressions, joins, aggregates and windows, so that it runs distributed and scales with the data.
"""

__version__ = "0.1.0"

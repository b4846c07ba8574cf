"""opinio: Spark-native review-corpus and sentiment analytics.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column helper)
built from Spark SQL expressions, joins, aggregations and windows, so that
Catalyst plans, prunes and pushes down across the whole chain.
"""

__version__ = "0.1.0"

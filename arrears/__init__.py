"""arrears — Spark-native analytics for debt-collection data.

DataFrame-in, DataFrame-out functions on Spark SQL and Spark ML: typed loaders, data-quality
profiles, strategy marts, point-in-time feature tables, A/B statistics, model evaluation and
score-based strategy economics.
"""

__version__ = "0.1.0"

"""listinglens: Spark-first operators for listing-valuation analytics."""

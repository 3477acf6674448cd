"""Spark-native market analytics over long tables of bars, filings, options and ticks."""

"""A Spark-first engine for the text inside technical drawings."""

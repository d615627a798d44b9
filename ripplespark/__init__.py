"""Change-impact analytics on PySpark: evidence joins, gates, noisy-or fusion and ranked results."""

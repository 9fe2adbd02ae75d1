"""Analytics over package-security tables, written as Spark DataFrame jobs."""

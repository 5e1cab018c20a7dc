"""Analytics over versioned, hierarchical document collections, as Spark DataFrame jobs."""

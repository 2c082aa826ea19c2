"""Analytics engine for open map data on Spark."""

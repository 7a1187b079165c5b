"""Track, place and route analytics on Spark."""

"""barloom: daily market-panel analytics as Spark jobs."""

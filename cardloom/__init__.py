"""Card-catalogue, collection and deck analytics as Spark DataFrame jobs."""

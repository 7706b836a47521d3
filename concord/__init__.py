"""Analytics engine for aligning, retrieving and reconciling documents, expressed as Spark plans."""

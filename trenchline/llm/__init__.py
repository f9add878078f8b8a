"""Training-data operators: one module per operator, all run as Spark jobs."""

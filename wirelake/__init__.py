"""A Spark engine for service-contract analysis."""

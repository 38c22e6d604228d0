"""Evidence analytics expressed as Spark DataFrame transformations."""

"""Event-discovery analytics expressed as Spark DataFrame transformations."""

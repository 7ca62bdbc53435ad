"""Change-risk analytics as lazy Spark DataFrame transformations."""

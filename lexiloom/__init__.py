"""lexiloom: text-corpus analytics as lazy Spark DataFrame transformations."""

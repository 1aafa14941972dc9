"""A Spark-native engine for marketplace product cubes and for preparing training text."""

"""A PySpark-native analytics engine: operators, sources, functions and queries as DataFrame plans."""

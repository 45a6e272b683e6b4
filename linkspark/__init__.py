"""A PySpark-native engine that resolves questions to the tables and columns of a schema, and scores such resolutions."""

"""A PySpark-native engine for agent memory: vectors, text, a temporal graph and their analytics as DataFrames."""

"""gridloom: a Spark-native engine for gridded data on space-filling curves."""

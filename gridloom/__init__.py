"""gridloom: a Spark-native engine for object-box annotation and evaluation tables."""

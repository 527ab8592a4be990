"""basaltql: a Spark-native SQL analytics engine (DataFrames, Spark SQL, Catalyst)."""

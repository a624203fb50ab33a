"""termloom: a Spark-native terminology annotation and text-data engine."""

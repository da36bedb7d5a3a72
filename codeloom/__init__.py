"""codeloom: a Spark-native code-intelligence and corpus engine."""

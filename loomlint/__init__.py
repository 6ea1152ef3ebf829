"""loomlint: a Spark-native code-quality and corpus analytics engine."""

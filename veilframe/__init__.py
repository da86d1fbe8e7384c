"""veilframe: a Spark-native engine for finding, replacing and accounting for sensitive text."""

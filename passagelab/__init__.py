"""passagelab: Spark-native passage cutting, scoring and retrieval over whole corpora."""

"""skarn: a Spark-native engine for document retrieval, conversation memory and telemetry."""

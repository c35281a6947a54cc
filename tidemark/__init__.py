"""tidemark: a Spark-native engine for event-time market data and corpus preparation."""

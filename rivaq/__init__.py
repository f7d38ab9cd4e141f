"""rivaq: a Spark-native retrieval and text-corpus analytics engine."""

"""siltstone: a Spark-native analytics engine for asset catalogues and training corpora."""

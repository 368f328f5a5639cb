"""sparkward: a Spark-native scanner for collections of source repositories and prompt text."""

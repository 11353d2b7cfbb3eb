"""A Spark-native engine for image analytics: images are rows, pixels can be rows too, operations are DataFrame expressions."""

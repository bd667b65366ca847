"""Spark-native building and auditing of labelled scene datasets, with training-data operators beside it."""

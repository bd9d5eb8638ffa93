"""Spark-native analytics for ensembles of graph-partition Markov chains."""

"""statewise: Spark-native analytics for trajectories and their Markov state models."""

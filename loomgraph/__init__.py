"""Graph analytics over edge lists on Spark: vertex programs as DataFrame plans."""

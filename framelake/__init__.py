"""framelake: particle-trajectory analytics on Spark DataFrames."""

"""Document-library alignment and portfolio reporting on Spark DataFrames."""

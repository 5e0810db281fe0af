"""Web-content analytics as Spark jobs: DataFrames in, DataFrames out."""

"""millrace: incremental multi-source ingestion, unification and reporting on Spark DataFrames."""

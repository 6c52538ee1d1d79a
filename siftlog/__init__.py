"""Log triage and corpus operators on Spark DataFrames."""

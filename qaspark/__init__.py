"""Question-answering evaluation, data quality and training-corpus operators on Spark DataFrames."""

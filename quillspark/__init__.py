"""Question-answering corpus jobs, expressed as Spark DataFrame plans."""

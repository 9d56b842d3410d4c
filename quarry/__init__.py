"""quarry: Spark-first curation, grading and evaluation analytics for reasoning datasets."""

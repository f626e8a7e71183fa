"""winnow: training-data selection as Spark DataFrame jobs."""

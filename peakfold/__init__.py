"""peakfold: a Spark-first analytics engine for array-valued scan and library data."""

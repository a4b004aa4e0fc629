"""cuespark: an analytics engine for time-coded transcripts on PySpark."""

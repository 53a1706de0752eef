"""panelforge: event-count panels and training-data corpora as Spark DataFrame jobs."""

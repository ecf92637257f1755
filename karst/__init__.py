"""Text-dataset curation, evaluation and telemetry analytics on Spark."""

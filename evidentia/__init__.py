"""Evidence-matching analytics and training-data preparation on Spark."""

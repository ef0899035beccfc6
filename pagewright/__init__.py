"""Text-to-audio alignment analytics and corpus preparation on Spark."""

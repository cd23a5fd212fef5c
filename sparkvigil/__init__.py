"""Log, alarm and corpus analytics as DataFrame-to-DataFrame functions on Spark."""

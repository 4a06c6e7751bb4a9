"""Account transfer, event history and ordered-stream analytics as Spark jobs."""

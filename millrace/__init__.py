"""Event-log analytics and text-corpus operators expressed as Spark jobs."""

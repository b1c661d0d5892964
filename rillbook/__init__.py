"""User-event analytics as plain ``DataFrame -> DataFrame`` Spark jobs."""

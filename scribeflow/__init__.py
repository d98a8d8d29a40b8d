"""A Spark engine for time-stamped, machine-produced text."""

"""Options, whole runs, and the queries by name."""

"""End-to-end jobs and the queries registered for checking."""

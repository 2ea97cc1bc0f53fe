"""End-to-end searches, and the queries that the driver runs."""

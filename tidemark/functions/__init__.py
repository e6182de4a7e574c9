"""Types and expressions of queries."""

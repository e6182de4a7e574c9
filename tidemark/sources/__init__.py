"""The versioned store."""

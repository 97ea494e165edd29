"""seclog."""

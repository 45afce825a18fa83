"""Edge lists as they arrive."""

"""streaming of lakeloom."""

"""operators of lakeloom."""

"""sources of lakeloom."""

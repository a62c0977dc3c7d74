"""functions of lakeloom."""

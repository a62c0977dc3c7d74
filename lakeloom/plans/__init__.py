"""plans of lakeloom."""

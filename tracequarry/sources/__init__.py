"""sources of the event-log engine."""

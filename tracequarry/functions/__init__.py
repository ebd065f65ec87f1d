"""functions of the event-log engine."""

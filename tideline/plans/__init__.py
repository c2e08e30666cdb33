"""plans of the event-analytics engine."""

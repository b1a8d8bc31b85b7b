"""Sources and sinks of the store."""

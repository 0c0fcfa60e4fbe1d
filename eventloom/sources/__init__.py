"""Sources and sinks of event tables, models and sequences."""

"""The same aggregates over streams: windows with watermarks, sessions, first occurrences and running state."""

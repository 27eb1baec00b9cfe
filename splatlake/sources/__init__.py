"""Sources and sinks of splat tables."""

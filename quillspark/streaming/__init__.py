"""Documents that arrive as a stream."""

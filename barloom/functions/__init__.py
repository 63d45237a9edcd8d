"""Column builders: window functions over ordered bars, scalar helpers, statistics."""

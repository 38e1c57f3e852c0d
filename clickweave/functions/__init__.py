"""Column functions: validation rules and scrubbing."""

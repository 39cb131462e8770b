"""Where data comes from and goes to: dimensions, messages, tables."""

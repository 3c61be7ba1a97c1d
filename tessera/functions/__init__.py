"""Column expressions: messages, templates, replies."""

"""Column expressions: recognisers, inference, conversion, JSON text, relations."""

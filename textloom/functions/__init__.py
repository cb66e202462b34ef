"""Column functions. All but those named in `functions.unicode` are built-in Catalyst expressions."""

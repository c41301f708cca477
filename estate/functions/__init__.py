"""Column helpers: predicates, text, masking, cursors, units."""

"""Sources and sinks: dictionary tables, matrices, class indexes, glyph images, JSON."""

"""Edge normalisation, vertex classes, algorithms and reports."""

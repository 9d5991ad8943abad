"""Training-data operators: corpus-scale jobs that the rest of the library does not import."""

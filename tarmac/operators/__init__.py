"""DataFrame -> DataFrame operators: cleaning, profiling, sampling, metrics."""

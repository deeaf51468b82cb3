"""DataFrame operators: generators, sampling, metrics, curves and models."""

"""DataFrame operators: keys and joins, ranks and frames, metrics, resampling, routing, models."""

"""DataFrame -> DataFrame building blocks: joins, aggregates, ordered operations, splits, metrics."""

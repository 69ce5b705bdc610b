"""Storage: schemas, match tables, catalog, sinks."""

"""Column-level functions: casts, array flattening, date spans and buckets."""

"""DataFrame in, DataFrame out. The streaming layers use the same functions as batch."""

"""Context reduction on Spark: detect what a block of text is, shrink it, keep the original within reach."""

"""A Spark engine for large text corpora: build, index, retrieve, assemble and measure."""

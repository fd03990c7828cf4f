"""Plan helpers: lineage cuts and joins that split hot keys."""

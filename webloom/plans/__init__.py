"""Plan helpers: skew-aware joins, lineage cuts and input sizing."""

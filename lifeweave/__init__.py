"""Personal-timeline analytics on Spark: typed sources, merging, cleaning, selection, enrichment and pair analytics."""

"""lakemeta: catalogs as tables — metadata discovery, lineage, diff and sync on Spark DataFrames."""

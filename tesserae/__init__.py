"""Tiling, target curation and stitching of spatial transcriptomics data, as Spark DataFrames."""

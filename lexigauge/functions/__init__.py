"""Column functions: characters, normalisation, segmentation, edit distance, flattening, audit."""

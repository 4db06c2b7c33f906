"""DataFrame operators: similarity, clustering, labelling, merging, quantiles."""

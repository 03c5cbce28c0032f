"""Study flows assembled from the operators, and the query registry."""

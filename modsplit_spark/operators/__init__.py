"""DataFrame operators: extraction, similarity, graphs, partitioning, clustering algebra, export."""

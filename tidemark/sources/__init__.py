"""Table contracts, snapshots, connectors."""

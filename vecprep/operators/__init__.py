"""DataFrame operators over vector sets and ground truth."""

"""DataFrame operators: detection, nodes, extraction, classification, links."""

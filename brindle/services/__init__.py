"""Front-end services: splitting, classification, lineage, review, schema differences, constraints, policies."""

"""End-to-end pipelines and the registry of driver queries."""

"""End-to-end jobs built from sources and operators."""

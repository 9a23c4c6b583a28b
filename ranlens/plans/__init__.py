"""Named analytical queries over the layers."""

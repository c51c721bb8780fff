"""Part of webstrata."""

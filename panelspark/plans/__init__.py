"""The panel that queries start from."""

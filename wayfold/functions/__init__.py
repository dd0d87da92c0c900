"""See the README for the contents of this subpackage."""

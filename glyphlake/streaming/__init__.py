"""Extension: drawings and edits as streams."""

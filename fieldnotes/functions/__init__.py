"""Part of fieldnotes."""

"""Readers, the note scan and the versioned table store."""

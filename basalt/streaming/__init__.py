"""A keyed table kept up to date by a stream of changes."""

"""Files of unsigned 64-bit integers, and text lines."""

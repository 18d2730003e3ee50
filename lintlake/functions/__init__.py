"""Column functions (text in, text or flag out); all of them run inside the JVM."""

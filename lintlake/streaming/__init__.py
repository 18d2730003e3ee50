"""The stateless steps on a stream of files or log rows."""

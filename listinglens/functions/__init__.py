"""Functions of listinglens."""

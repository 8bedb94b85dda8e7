"""Sources of listinglens."""

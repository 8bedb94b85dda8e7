"""Plans of listinglens."""

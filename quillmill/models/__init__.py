"""Model-backed steps behind plain batch functions."""

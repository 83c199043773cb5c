"""Object storage over Hadoop file systems."""

"""Marlstone: equity-research analytics as DataFrame-to-DataFrame Spark operators."""

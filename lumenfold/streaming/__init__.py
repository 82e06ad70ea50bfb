"""Running results over streams of edges."""

"""Column functions: text, URLs, permissions, HTML fields and scores."""

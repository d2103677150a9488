"""Column functions: text, prices, URLs, HTML, JSON."""

"""Column expressions: URLs, predicates, HTML, JSON payloads, dates, locations, replies."""

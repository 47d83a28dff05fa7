"""Column-to-Column functions: text, dates, hints, geometry, tags, opening hours, urls, matching."""

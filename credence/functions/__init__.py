"""Column-level building blocks: text, names, links, dates, rule outcomes and hot-key aggregation."""

"""Column functions: tokens, links, sections, literals, digests, rounding."""

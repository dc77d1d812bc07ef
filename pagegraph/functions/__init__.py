"""Native column expressions: text, times, wiki addresses and graph terms."""

"""Training-data operators: near-duplicates, quality, tokenizing, URL rules, secrets, language,
sharding and packing. Nothing else in the library imports this subpackage."""

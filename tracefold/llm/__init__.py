"""Training-data operators: sharding, tokenising, joins, classifiers,
language models, language identification, packing, personal data, quality
rules, vector search, prefix tries, toxicity and centroid clustering.  Nothing outside this package imports it."""

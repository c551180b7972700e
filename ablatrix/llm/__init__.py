"""Training-data operators: media columns, near-duplicates, personal data, licences, WARC, toxicity, BPE,
secrets, nearest neighbours, source mixing, vector codes, clusters and near-duplicates of vectors. Nothing outside this subpackage imports it."""

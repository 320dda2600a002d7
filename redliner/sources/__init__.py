"""Reading, parsing and writing of documents, packs, logs and bundles."""

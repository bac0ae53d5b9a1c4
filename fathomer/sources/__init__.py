"""Where rows come from: files, parsers and embedders."""

"""Where rows come from: landing folders, message streams, batch files."""

"""Where rows come from: repositories, version history, manifests."""

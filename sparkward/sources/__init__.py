"""Where rows come from: repositories, manifests, baselines, scan state."""

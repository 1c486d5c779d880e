"""Plans composed of operators: drivers, scores, panels, gates, setups, validation."""

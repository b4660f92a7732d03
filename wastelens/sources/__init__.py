"""Where the domain tables come from, and where results go."""

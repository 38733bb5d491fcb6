"""Where logs and their side tables come from."""

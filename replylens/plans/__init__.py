"""Plans that put operators together: evaluation and report tables."""

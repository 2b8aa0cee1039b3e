"""What plans need from a session."""

"""Where state and operations come from, and where they go."""

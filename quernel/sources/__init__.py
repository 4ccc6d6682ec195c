"""Sources: files, pages, JSON Lines, skills, sessions, settings."""

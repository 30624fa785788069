"""Where notes come from and where parsed notes are kept."""

"""Plan shapes that Catalyst can't choose by itself."""

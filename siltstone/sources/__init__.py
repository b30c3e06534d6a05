"""Where pages, site configurations and lists of urls come from."""

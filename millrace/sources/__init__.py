"""Log sources: files, container logs, log groups."""

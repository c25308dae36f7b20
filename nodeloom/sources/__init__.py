"""Sources: workspace exports, seed files, attachments."""

"""Quality control of repeat gridded surveys, as Spark plans over pixel tables."""

"""loomstone: web-page extraction, quality analytics and corpus preparation on Spark."""

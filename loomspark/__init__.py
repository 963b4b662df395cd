"""loomspark: analytics over anchored Markdown corpora, planned and run by Spark."""

"""chainloom: redirection graphs, browser logs and chain features on Spark."""

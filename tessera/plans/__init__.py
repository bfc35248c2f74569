"""Query languages: text to a tree on the driver, tree to a DataFrame plan."""

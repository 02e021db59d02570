"""Template programs over values: parsing, abstract interpretation to contract rows, and their distribution over Spark."""

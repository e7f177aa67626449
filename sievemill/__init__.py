"""sievemill: text analytics over columns of machine-generated text, on Spark."""

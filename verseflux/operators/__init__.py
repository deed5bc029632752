"""DataFrame -> DataFrame operators. Column names are arguments; nothing is collected here
unless a model has to be fitted or a size has to be checked."""

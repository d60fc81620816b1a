"""genoloom: single-cell genotype-distance analytics as DataFrame plans."""

"""Marker-specificity analytics on Spark: markers, entropies, rankings and rank tests as DataFrame plans."""

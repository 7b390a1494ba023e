"""Inference over streams of triples."""

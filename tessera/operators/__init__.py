"""Pair generation, graphs, inference, consistency, active learning, clustering, evaluation."""

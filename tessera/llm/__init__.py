"""Operators for large-scale training-data pipelines (see README, "Training-data operators")."""

"""Operators for training data: canonical lists, similarity clusters, packing, mixing and residue. Nothing else imports them."""

"""Clusterers with one protocol: fit_predict(df, features, seed, key) -> (labels, extras).

The labels table holds the key, ``cluster_label`` (1..K, -1 for noise) and
``membership_strength`` (null when the method has none).
"""

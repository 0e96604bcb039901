"""DataFrame operators on grouped samples: pooling, scaling, ranking quality, splits, audits, tensors, models."""

"""Operators for text corpora measured in tokens: packing, mixing and splitting."""

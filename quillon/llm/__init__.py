"""Operators for preparing training data at scale. Nothing else in quillon imports this subpackage."""

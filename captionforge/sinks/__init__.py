"""Writers and publish plans."""

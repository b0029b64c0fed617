"""Writers and append targets."""

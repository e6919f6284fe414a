"""streaming of claimloom."""

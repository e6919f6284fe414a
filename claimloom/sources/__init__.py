"""sources of claimloom."""

"""functions of claimloom."""

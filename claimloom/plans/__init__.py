"""plans of claimloom."""

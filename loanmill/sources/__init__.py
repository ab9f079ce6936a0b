"""Reading uploads and keeping the loan tables."""

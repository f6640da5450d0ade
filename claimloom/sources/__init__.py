"""Part of claimloom: sources."""

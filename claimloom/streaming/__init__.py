"""Part of claimloom: streaming."""

"""Part of claimloom: operators."""

"""Part of claimloom: functions."""

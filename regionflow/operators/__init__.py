"""Operators: functions from DataFrame to DataFrame, without actions unless a fit needs one."""

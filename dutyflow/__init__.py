"""Duty-roster and payslip analytics expressed as Spark DataFrame plans."""

"""Composite reports (the audit tool's commands) as DataFrame plans."""

"""Structured Streaming form of the audit refresh."""

from inboxlens.streaming.incremental_audit import AuditPaths, apply_batch, current_senders, latest_snapshot, start_incremental_audit

__all__ = ["AuditPaths", "apply_batch", "current_senders", "latest_snapshot", "start_incremental_audit"]

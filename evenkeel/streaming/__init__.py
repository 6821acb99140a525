from evenkeel.streaming.monitor import start_audit_monitor

__all__ = ["start_audit_monitor"]

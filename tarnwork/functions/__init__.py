"""Part of tarnwork; see the modules."""

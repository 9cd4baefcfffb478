"""Operators over job items: fan-out, routing, loops, the checkpoint ledger and inference."""

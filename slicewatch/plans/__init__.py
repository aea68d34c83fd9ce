"""End-to-end jobs composed from operators: diagnose, run a policy, persist, read views."""

"""Registered queries, by family. Each program declares its plan with DataFrame functions and has its SQL beside it."""

"""Live replay: stack depth of events as they arrive."""

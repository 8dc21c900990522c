"""Training-data operators; nothing else in echolith imports this subpackage."""

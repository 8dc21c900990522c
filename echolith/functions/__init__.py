"""Part of echolith."""

"""Part of loomspark."""

"""Part of lexiloom; see the modules."""

"""The panel pipeline: build, prepare, model, diagnose."""

"""Whole flows built from operators. Import the submodules directly."""

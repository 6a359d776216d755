"""DataFrame operators. Import the submodules directly."""

"""Small numpy solvers that run inside grouped tasks."""

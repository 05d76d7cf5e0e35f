"""Perturbation plans and the jobs that run them."""

"""Column functions: portable randomness, noise, error measures."""

from .noise import bernoulli, gumbel, laplace, laplace_clamped, uniform
from .errors import is_correct, normalized_error, relative_error, relative_error_eps

__all__ = ["bernoulli", "gumbel", "is_correct", "laplace", "laplace_clamped", "normalized_error", "relative_error", "relative_error_eps", "uniform"]

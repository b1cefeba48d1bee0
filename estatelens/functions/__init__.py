"""Column-level building blocks (``Column -> Column``) and Arrow kernels."""

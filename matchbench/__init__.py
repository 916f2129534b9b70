"""Evaluation of template-matching experiments as DataFrame plans."""

"""Lowering of syntax trees to DataFrame plans."""

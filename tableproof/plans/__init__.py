"""Workflows: sequences of gates and steps that end in a verdict, a plan or a published copy."""

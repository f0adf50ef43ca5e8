"""Whole jobs: read list files, apply an operator, write the result, return the figures.

Figures come back as lazy DataFrames; nothing is collected here. Jobs over a folder work layout by
layout (files with the same header share one plan) and write one output folder per input file.
"""

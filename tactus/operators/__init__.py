"""tactus.operators"""

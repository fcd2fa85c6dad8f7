"""tactus.sources"""
